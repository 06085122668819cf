"""WARC records in ZIP packages: a writer, and a reader that takes records by ranges without extraction.

A package is a ZIP archive with two stored members: `archive/data.warc.gz`, one gzip member per record, and
`indexes/index.cdxj`, a line for each record with its key, kind, digest, offset and length, sorted by key. Because members are stored,
a record's place in the package is the member's data offset plus the record's offset, and one range read fetches it.

The reader parses the end-of-directory record, its ZIP64 locator and directory when sizes or counts need them, the central
directory with ZIP64 extra fields, and the local header, whose name and extra lengths may differ from the directory's. It
works on any seekable file, so pyarrow's file systems serve local, HDFS and object stores alike."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

# fixed values of the ZIP format
END, END64, LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
ENTRY, LOCAL = b"PK\x01\x02", b"PK\x03\x04"
ZIP64_FIELD, ALL16, ALL32 = 0x0001, 0xFFFF, 0xFFFFFFFF
STORED = 0

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: 1980-01-01 in DOS form, so that equal records give equal packages.
DOS_DATE = (1 << 5) | 1


class BadPackage(ValueError):
    """The bytes are not a package that the reader understands."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    crc: int
    header: int


def read_range(f: BinaryIO, offset: int, size: int) -> bytes:
    f.seek(offset)
    data = f.read(size)
    if len(data) != size:
        raise BadPackage(f"{size} bytes wanted at {offset}, {len(data)} found")
    return data


def directory(f: BinaryIO, length: int) -> list[Member]:
    """The members in the central directory of a file of `length` bytes."""
    tail_at = max(0, length - 65_557 - 20)
    tail = read_range(f, tail_at, length - tail_at)
    at = tail.rfind(END)
    # a comment may hold the mark: the real record's comment ends the file
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise BadPackage("no end of central directory")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if count == ALL16 or ALL32 in (size, offset):
        if at < 20 or tail[at - 20 : at - 16] != LOCATOR64:
            raise BadPackage("no ZIP64 locator")
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        record = read_range(f, where, 56)
        if record[:4] != END64:
            raise BadPackage("no ZIP64 end of central directory")
        count, size, offset = struct.unpack_from("<QQQ", record, 32)
    entries, at, out = read_range(f, offset, size), 0, []
    for _ in range(count):
        if entries[at : at + 4] != ENTRY:
            raise BadPackage("a directory entry is damaged")
        method, crc, packed, plain, name_n, extra_n, note_n = struct.unpack_from("<H4xIIIHHH", entries, at + 10)
        header = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + name_n].decode()
        extra, x = entries[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while x + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, x)
            if tag == ZIP64_FIELD:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                plain = next(wide) if plain == ALL32 else plain
                packed = next(wide) if packed == ALL32 else packed
                header = next(wide) if header == ALL32 else header
            x += 4 + n
        out.append(Member(name, method, plain, packed, crc, header))
        at += 46 + name_n + extra_n + note_n
    return out


def data_offset(f: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != STORED:
        raise BadPackage(f"{member.name} is not stored")
    local = read_range(f, member.header, 30)
    if local[:4] != LOCAL:
        raise BadPackage(f"{member.name} has no local header")
    name_n, extra_n = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + name_n + extra_n


class Package:
    """An opened package: its index, and its records by range."""

    def __init__(self, f: BinaryIO, length: int) -> None:
        self.f = f
        self.members = {m.name: m for m in directory(f, length)}
        if DATA not in self.members or INDEX not in self.members:
            raise BadPackage("the package has no archive or no index")
        self.data = data_offset(f, self.members[DATA])

    def index(self) -> Iterator[dict]:
        """The index lines; the member's CRC is checked."""
        m = self.members[INDEX]
        text = read_range(self.f, data_offset(self.f, m), m.size)
        if zlib.crc32(text) != m.crc:
            raise BadPackage("the index is damaged")
        for line in text.splitlines():
            yield json.loads(line.split(b" ", 2)[2])

    def record(self, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        """Headers, names in lower case, and block of one record."""
        if offset + length > self.members[DATA].size:
            raise BadPackage("the index points outside the archive")
        return parse_record(gzip.decompress(read_range(self.f, self.data + offset, length)))


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def index_key(url: str) -> str:
    """A sort key that puts pages of a host and its subdomains together: the host's labels from last to first, without a
    leading www, then the path and query; scheme, user and standard ports left out. Others are their own key."""
    scheme, mark, rest = url.partition("://")
    if not mark:
        return quote(url, safe="/:;,=+()!*~@$'-._?&%")
    host, cut, path = re.match(r"([^/?#]*)(/?)([^#]*)", rest, re.S).groups()
    host = host.rpartition("@")[2].lower()
    name, _, port = host.partition(":")
    labels = name.removeprefix("www.").split(".")[::-1]
    shown = "" if port in ("", "80", "443") else f":{port}"
    return quote(f"{','.join(labels)}{shown}){cut or '/'}{path}".lower(), safe="/:;,=+()!*~@$'-._?&%")


def make_record(kind: str, name: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member: a WARC 1.1 record. White space in header values becomes single spaces."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "1980-01-01T00:00:00Z"), *headers]
    lines += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        raise BadPackage("no WARC record")
    headers = {}
    for line in head.decode().split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise BadPackage("a record's length is wrong")
    return headers, rest[:n]


class PackageWriter:
    """Writes records one by one to a stream that need not seek; sizes follow in a data descriptor. The ZIP64 forms are
    used where sizes need them, or always with `wide`."""

    def __init__(self, out: BinaryIO, wide: bool = False) -> None:
        self.out, self.at, self.wide, self.lines, self.entries = out, 0, wide, [], []
        self.size, self.crc = 0, 0
        self._open(DATA)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _open(self, name: str) -> None:
        self.header, self.name, self.size, self.crc = self.at, name.encode(), 0, 0
        # flag 8: CRC and sizes follow the data, in 64-bit form as the empty ZIP64 field says
        extra = struct.pack("<HHQQ", ZIP64_FIELD, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, STORED, 0, DOS_DATE, 0, ALL32, ALL32, len(self.name), len(extra)) + self.name + extra)

    def _data(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)

    def _close(self) -> None:
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, self.size, self.size))
        self.entries.append((self.name, self.crc, self.size, self.header))

    def add(self, kind: str, name: str, headers: list[tuple[str, str]], block: bytes, facts: dict, key: str) -> None:
        offset, data = self.size, make_record(kind, name, headers, block)
        self._data(data)
        line = {"offset": offset, "length": len(data), "type": kind, "record": name, **facts}
        self.lines.append((key, f"{key} 19800101000000 {json.dumps(line)}\n".encode()))

    def close(self) -> None:
        self._close()
        self._open(INDEX)
        for _, line in sorted(self.lines):
            self._data(line)
        self._close()
        start = self.at
        for name, crc, size, header in self.entries:
            wide = [v for v in (size, size, header) if self.wide or v >= ALL32]
            if wide and not self.wide:
                wide = ([size, size] if size >= ALL32 else []) + ([header] if header >= ALL32 else [])
            short = lambda v: ALL32 if self.wide or v >= ALL32 else v
            extra = struct.pack(f"<HH{len(wide)}Q", ZIP64_FIELD, 8 * len(wide), *wide) if wide else b""
            self._put(
                ENTRY
                + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, STORED, 0, DOS_DATE, crc, short(size), short(size), len(name), len(extra), 0, 0, 0, 0, short(header))
                + name
                + extra
            )
        size, count = self.at - start, len(self.entries)
        if self.wide or start >= ALL32 or size >= ALL32:
            where = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, where, 1))
            self._put(END + struct.pack("<HHHHIIH", 0, 0, ALL16, ALL16, ALL32, ALL32, 0))
        else:
            self._put(END + struct.pack("<HHHHIIH", 0, 0, count, count, size, start, 0))
