"""WARC packages of a table of pages: written by one set of tasks, read back by another.

Which record stands for equal payloads is settled on digests alone: a payload is hashed where it is read, the largest id
of each digest is an aggregate, and only this narrow table is joined with the pages by id, which also deals the pages
evenly over packages, whatever their payloads' sizes of groups.

A task streams its records into a package under a name of its own in the shared folder, and reports it; reports are
staged, so a task that runs twice leaves at most a file that nobody reads. Readers get one row per package, parse its
directory, and range-read its records, all others untouched.

A response holds an HTTP message, a status line, the payload's type and length, and the payload; a revisit holds its
headers alone and refers to the response's record and URL. Record names are the pages' ids, dates are a constant, since the
table has none, and the index is keyed by the URL with its host's labels reversed.

Defined results: a null html is an empty payload; a page without a URL has its record's name as its target. Payloads
shorter than `least` bytes are never revisits. Ids may be of any type that reads back from its text; a null id is the
smallest. Rows that repeat the largest id of a digest are all responses. An empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, new_path, staged
from .zipwarc import Package, PackageWriter, digest, index_key

#: Payload bytes of a package.
PACKAGE_BYTES = 16_000_000
#: Rows of a package that the reader returns at once.
CHUNK = 64


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it; a path without a scheme is a local one."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


#: Names of records: those of pages, and that of pages without an id.
PAGE, NO_PAGE = "urn:page:", "urn:page-without-id"
RESPONSE = "application/http; msgtype=response"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_name(page: str | None) -> str:
    return NO_PAGE if page is None else PAGE + quote(page, safe="")


def page_of(name: str) -> str | None:
    """The id, as text, in a record's name, which stands in angle brackets."""
    name = name.strip("<>")
    return unquote(name[len(PAGE) :]) if name.startswith(PAGE) else None


def http_head(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()


def kinds(pages: DataFrame, id_col: str, payload: Column, url: Column, least: int = 0, parts: int | None = None) -> DataFrame:
    """(id, url, payload, refers_to, refers_url, revisit): refers_to is the largest id with an equal payload where another
    id has it. Only digests of two ids or more are looked up, and each id and digest once."""
    rows = pages.select(F.col(id_col).alias("id"), url.cast("string").alias("url"), payload.alias("payload"))
    narrow = rows.select("id", "url", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes"))
    narrow = staged(narrow.groupBy("id", "sha1", "bytes").agg(F.min("url").alias("url")), "digests")
    top = narrow.where(F.col("bytes") >= least).groupBy("sha1").agg(F.max(F.struct("id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1")
    top = top.select("sha1", F.col("top.id").alias("top"), F.col("top.url").alias("top_url"))
    revisits = narrow.join(top, "sha1").where(~F.col("id").eqNullSafe(F.col("top"))).select(F.col("id").alias("rid"), "sha1", "top", "top_url")
    # the page's id and digest decide its package: one exchange deals the pages out and serves the join
    key = lambda i, d: F.xxhash64(i, d)
    of = rows.withColumn("own", F.sha1("payload")).withColumn("key", key("id", "own"))
    of = of if parts is None else of.repartition(parts, "key")
    revisits = revisits.withColumn("rkey", key("rid", "sha1"))
    same = (F.col("key") == F.col("rkey")) & F.col("id").eqNullSafe(F.col("rid")) & (F.col("own") == F.col("sha1"))
    out = of.join(revisits.hint("shuffle_merge"), same, "left")
    return out.select("id", "url", "payload", F.col("top").alias("refers_to"), F.col("top_url").alias("refers_url"), F.col("sha1").isNotNull().alias("revisit"))


def _writer(folder: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = out = package = path = None
        n = 0
        for b in batches:
            for page, url, payload, top, top_url, revisit in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if package is None:
                    store, at = _store(folder)
                    store.create_dir(at, recursive=True)
                    path = f"{at}/{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(path)
                    package = PackageWriter(out)
                sha, name = digest(payload), record_name(page)
                target = url or name
                facts = {"url": target, "digest": sha, "bytes": len(payload)}
                headers = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", RESPONSE)]
                head = http_head(payload)
                if revisit:
                    of = record_name(top)
                    headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{of}>"), ("WARC-Refers-To-Target-URI", top_url or of)]
                block = head if revisit else head + payload
                package.add("revisit" if revisit else "response", name, headers, block, facts, index_key(target))
                n += 1
        if package is not None:
            package.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [path.rpartition("/")[2]], "records": [n]})

    return write


def write_packages(pages: DataFrame, id_col: str, payload: Column, url: Column, least: int = 0) -> tuple[str, DataFrame]:
    """The folder of the packages, and the staged table (name, records) of them."""
    spark = pages.sparkSession
    bound_batches(spark)
    folder = new_path(spark, "packages")
    size = pages.agg(F.coalesce(F.sum(F.octet_length(payload)), F.lit(0))).collect()[0][0]
    parts = max(int(spark.sparkContext.defaultParallelism), -(-size // PACKAGE_BYTES))
    rows = kinds(pages, id_col, payload, url, least, parts)
    rows = rows.withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return folder, staged(rows.mapInArrow(_writer(folder), "name string, records bigint"), "manifest")


def _reader(folder: str) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_file(f"{at}/{name}") as f:
                    package = Package(f, f.size())
                    rows: dict[str, list] = {c: [] for c in COLUMNS}
                    for line in package.index():
                        headers, block = package.record(line["offset"], line["length"])
                        kind = headers["warc-type"]
                        sha = headers["warc-payload-digest"].removeprefix("sha1:")
                        n = int(headers["x-payload-length"])
                        body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if kind == "response" and (digest(body) != sha or len(body) != n):
                            raise ValueError(f"the payload of {headers['warc-record-id']} is damaged")
                        refers = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
                        found = (page_of(headers["warc-record-id"]), headers["warc-target-uri"], kind, refers, n, sha, body)
                        for c, v in zip(rows, found, strict=True):
                            rows[c].append(v)
                        if len(rows["type"]) == CHUNK:
                            yield _batch(rows)
                            rows = {c: [] for c in rows}
                    yield _batch(rows)

    return read


COLUMNS = {"page_id": pa.string(), "url": pa.string(), "type": pa.string(), "refers_to": pa.string(), "bytes": pa.int64(), "digest": pa.string(), "payload": pa.binary()}


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in COLUMNS.items()], names=list(COLUMNS))


def read_packages(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, url, type, refers_to, bytes, digest, payload) of every record of the listed packages; the payload is null
    for revisits, whose bytes and digest are those of the payload that they refer to."""
    n = manifest.count()
    names = manifest.select("name").repartition(max(1, n))
    out = names.mapInArrow(_reader(folder), "page_id string, url string, type string, refers_to string, bytes bigint, digest string, payload binary")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
