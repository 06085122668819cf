"""Packing token sequences by minimum bin slack.

Texts are tokenised whole; a text's ids end with a separator id. Full windows are cut off the front of a text, and what
remains, 1 to window - 1 ids, is a piece to be packed. Full windows are sequences at once; pieces are gathered, in the
order of the records, in groups of about GROUP_IDS ids, so what was shuffled together is packed together. In a group, each window starts with the longest piece left; a bitset subset-sum over the multiset of the remaining
lengths, longest first, finds which totals the rest of the window can take; the highest reachable total wins, at once if
it fills the window, and the counts of each length are backtracked. When too few pieces are left for a good fit, the
next piece is cut to fill the window, so a group leaves one short sequence at most.

Records stay in the partition in which they are read, and nothing is exchanged by a key, so no source, group of copies or
long text can gather in one task; what a task holds is a group, whatever its partition. Partitions of less text than
that are read together first, so that short sequences stay few. A task that runs again reads the same records in the same
order and gives the same sequences.

Defined results: a null text is an empty one, whose ids are the separator alone. Repeated rows are packed each on their
own. An empty table gives an empty result. Very long texts give many full windows. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, spread

WINDOW = 2048
SEPARATOR = 1
#: Ids of a group, two bytes each, that are held in memory while it is packed, and its pieces at most.
GROUP_IDS = 4_000_000
GROUP_PIECES = 200_000
#: Text of a task, at least, and of a task of a table that has less than that for each core; what a record counts besides
#: its text.
TASK_BYTES = 16_000_000
LEAST_BYTES = 3_000_000
RECORD_BYTES = 64
CHUNK = 256


#: Letters of ASCII and Latin-1, then ASCII marks but the apostrophe: such a word is one run of each, lower-cases letter
#: by letter and is its own normal form.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte: itself if it prints, else the next
    free one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class WordIds(dict):
    """The ids of a word as little-endian 16-bit numbers, remembered up to a bound. A tokeniser that drops white space
    and never joins across it gives a text's ids as those of its words in a row; plain words go straight to its model."""

    bound = 300_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.runs: dict[str, bytes] = {}

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def run(self, text: str) -> bytes:
        """Ids of one run of lower-case letters or of marks."""
        found = self.runs.get(text)
        if found is None:
            written = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
            found = np.array([t.id for t in self.model.tokenize(written)], "<u2").tobytes()
            if len(text) <= 48:
                if len(self.runs) >= self.bound:
                    self.runs.clear()
                self.runs[text] = found
        return found

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain:
            ids = (self.run(plain[1].lower()) if plain[1] else b"") + (self.run(plain[2]) if plain[2] else b"")
        else:
            ids = np.array(self.encode(word), "<u2").tobytes()
        if len(word) <= 48:
            if len(self) >= self.bound:
                self.clear()
            self[word] = ids
        return ids


def word_tokens(text: str, known: WordIds) -> bytes:
    """Ids of a text, word by word, and the separator."""
    words = filter(None, text.replace("\n", " ").split(" "))
    return b"".join(map(known.__getitem__, words)) + SEPARATOR.to_bytes(2, "little")


def subset(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length to take so that their total comes closest to room from below. counts is walked
    from long to short, and the walk ends as soon as the room can be filled."""
    limit, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            out[length] = out.get(length, 0) + take
    return out


def pack(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start in the piece, length); pieces are shorter than the window. A piece is cut only if the
    best subset leaves slack."""
    by: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        by.setdefault(lengths[i], []).append(i)
    counts = {n: len(x) for n, x in by.items()}
    out, cut = [], None

    def pop(n: int) -> int:
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
        return by[n].pop()

    while counts or cut:
        if cut:
            i, start, n = cut
            seq, room, cut = [(i, start, n)], window - n, None
        else:
            n = max(counts)
            seq, room = [(pop(n), 0, n)], window - n
        for n, c in subset(counts, room).items():
            for _ in range(c):
                seq.append((pop(n), 0, n))
                room -= n
        if room and counts:
            n = min(x for x in counts if x > room)
            i = pop(n)
            seq.append((i, 0, room))
            cut = (i, room, n - room)
        out.append(seq)
    return out


def _packer(path: str, window: int, tokens: Callable = word_tokens) -> Callable:
    """(id, text) rows to packed pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(path)
        sequence = TaskContext.get().partitionId() << 32
        group, held = [], 0  # pieces (id, start, ids of the document, ids), and how many ids they have
        out: list[tuple] = []
        kind = None

        def flush() -> None:
            nonlocal sequence, held
            for seq in pack([len(p[3]) // 2 for p in group], window):
                place = 0
                for i, s, n in seq:
                    doc, start, total, ids = group[i]
                    out.append((doc, start + s, n, total, sequence, place, ids[2 * s : 2 * (s + n)]))
                    place += n
                sequence += 1
            group.clear()
            held = 0

        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, whole.num_rows, CHUNK):
                part = whole.slice(at, CHUNK)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    t = tokens(text or "", known)
                    total = len(t) // 2
                    for s in range(0, total, window):
                        ids = t[2 * s : 2 * (s + window)]
                        if len(ids) == 2 * window:
                            out.append((doc, s, window, total, sequence, 0, ids))
                            sequence += 1
                        else:
                            group.append((doc, s, total, ids))
                            held += len(ids) // 2
                    if len(out) >= 4096:
                        yield _batch(out, kind)
                        out = []
                    if held >= GROUP_IDS or len(group) >= GROUP_PIECES:
                        flush()
        if group:
            flush()
        for at in range(0, len(out), 4096):
            yield _batch(out[at : at + 4096], kind)

    return run


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    doc, start, length, total, sequence, offset, ids = zip(*rows, strict=True)
    crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids]
    whole = {"start": start, "length": length, "ids_crc32": crc, "doc_tokens": total, "sequence_id": sequence, "offset": offset}
    return pa.RecordBatch.from_arrays([pa.array(doc, kind), *[pa.array(x, pa.int64()) for x in whole.values()], pa.array(ids, pa.binary())], names=["id", *whole, "ids"])


def pack_texts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): the pieces of all sequences, ids as
    little-endian 16-bit numbers, and the CRC-32 of them as 32-bit ones. tokenizer is the path of a vocabulary of at most 65,536 ids that every executor can read."""
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES), F.lit(0))).collect()[0][0]
    tasks = max(1, -(-size // TASK_BYTES), min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
    return spread(docs).coalesce(tasks).mapInArrow(
        _packer(tokenizer, window),
        f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary",
    )


def digests(packed: DataFrame) -> DataFrame:
    """The packed pieces without their ids."""
    return packed.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
