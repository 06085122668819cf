"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each text becomes its set of five-word shingles, a 128-bit key of that set and a signature of 64 coordinates. Texts
   with equal sets form one class, so copies of any number cost one node.
2. Every class is posted under its (coordinate, value) pairs. Values that occur once are dropped, since they can't
   collide; the rest are ordered from rare to frequent, the same way for all. Two classes that agree in at least
   matches(percent) coordinates must meet under one of the 64 - matches(percent) + 1 rarest values of both, so only this prefix is merged:
   the long lists are skipped, and probed through the full signatures that each posting carries.
3. Lists are walked in their tasks. Collisions are counted on the spot, and a list yields no pairs but the edges of its
   maximum spanning forest over counts of at least matches(percent): fewer than it has members. These pairs are confirmed by the
   exact Jaccard similarity of the full sets, and the confirmed links make components.
4. Lists that still mix components are walked again: the members that agree in matches(percent) coordinates with one of
   another component get their full sets, and are compared exactly with all of these; again a list yields a forest of confirmed
   links. Pairs inside a component need no look, so no group is multiplied out, and no pair between components is left
   out.
5. Lists that are long, or heavy, are cut into blocks. In step 3 each block is walked by itself; then the components that
   a list holds meet again by one member each, so that a large group becomes one component. In step 4 only the members
   outside a list's largest component, the few, go to every block, and blocks of these few against blocks of all, so that
   no task holds more than two blocks and a list of one group is never multiplied.

matches(percent) follows from the wanted similarity, so that a pair exactly there agrees in fewer coordinates with a
probability of at most MISS = 5 in 100,000, and the more similar, the less: 42 of 64 at 85 percent (3.0 in 100,000), 38
at 80 (4.3), 30 at 70 (3.4), 17 at 50 (3.9). Below 15 percent no number of coordinates holds that, which is an error.
Everything behind that is exact.

Defined results: null or empty texts, and texts without words, have the empty set and are linked with nothing. A text
of fewer words than a shingle has is linked only with equal word sequences. Rows without an id take part; a component's
id is the least id in it, null if none has one. Repeated rows are linked as copies are. Of the input only the id and
text columns are read, so other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import bound_batches, spread, staged
from .components import connected
from .shingles import COORDINATES, WordHashes, class_key, intersection, shingle_set, signature

#: Probability, at most, with which a pair at exactly the wanted similarity is missed.
MISS = 5e-5
#: Similarity of linked texts, in hundredths.
PERCENT = 85
#: Members of a block of a list, and shingles.
BLOCK = 2048
BLOCK_SHINGLES = 1_000_000
P = "__neardup_"
#: Texts that are held at once while they are signed.
CHUNK = 256


def matches(percent: int) -> int:
    """Coordinates in which a pair must agree to be confirmed: the most that a pair of this similarity reaches but for
    MISS. Each coordinate agrees with the similarity as its probability."""
    p, most, below = percent / 100, 0, 0.0
    while most < COORDINATES:
        below += math.comb(COORDINATES, most) * p**most * (1 - p) ** (COORDINATES - most)
        if below > MISS:
            break
        most += 1
    if not most:
        raise ValueError(f"{COORDINATES} coordinates can't find pairs at {percent} percent")
    return most


def _texts(column: pa.ChunkedArray | pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(at, CHUNK)
            sizes, keys, signatures = [], [], []
            for text in _texts(batch.column(1)):
                s = shingle_set(text, known)
                sizes.append(len(s))
                keys.append(class_key(s) if len(s) else None)
                signatures.append(signature(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(signatures, pa.list_(pa.int32())),
                ],
                names=["id", "n", "cls", "sig"],
            )


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The lists of a partition that is sorted by (key, i, j), one table each; a list may span batches."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
        cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        start = 0
        for end in cut.tolist():
            yield t.slice(start, end - start)
            start = end
        held = t.slice(start)
    if held is not None and held.num_rows:
        yield held


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _fits(n: int, m: np.ndarray, percent: int) -> np.ndarray:
    """A bound on sizes that no linked pair breaks."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _forest(percent: int):
    """Lists of (key, i, j, nid, n, sig) to the edges of their maximum spanning forests."""
    enough = matches(percent)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, held = [], [], 0
        for t in _lists(batches):
            if t.num_rows < 2:
                continue
            nid, n = t.column("nid").to_numpy(), t.column("n").to_numpy()
            sig = _rows(t.column("sig").combine_chunks())
            # Prim's algorithm: best[k] is the highest count of k with the tree so far, by[k] whom it has it with
            best, by = np.full(len(nid), -1), np.zeros(len(nid), np.int64)
            best[0], now = 0, 0
            done = np.zeros(len(nid), bool)
            for _ in range(len(nid)):
                done[now] = True
                count = np.where(_fits(n[now], n, percent), (sig == sig[now]).sum(axis=1), 0)
                better = ~done & (count > best)
                best[better], by[better] = count[better], now
                if done.all():
                    break
                now = int(np.where(done, -2, best).argmax())
                if best[now] >= enough:
                    xs.append(nid[now : now + 1])
                    ys.append(nid[by[now] : by[now] + 1])
                    held += 1
            if held > 50_000:
                yield _edges(xs, ys)
                xs, ys, held = [], [], 0
        yield _edges(xs, ys)

    return walk


def _live(percent: int):
    """Lists of (key, i, j, nid, n, sig, component, few) to (key, i, j, nid): the members that agree in matches(percent)
    coordinates with a member of another component. Where `few` is not null, the few are compared with the others."""
    enough = matches(percent)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _lists(batches):
            of = t.column("component").to_numpy()
            names, which, counts = np.unique(of, return_inverse=True, return_counts=True)
            if len(names) < 2:
                continue
            n, sig = t.column("n").to_numpy(), _rows(t.column("sig").combine_chunks())
            live = np.zeros(len(of), bool)
            few = t.column("few").to_numpy(zero_copy_only=False) if t.column("few").null_count == 0 else None
            asked, others = (which != counts.argmax(), np.ones(len(of), bool)) if few is None else (few.astype(bool), ~few.astype(bool))
            for u in np.flatnonzero(asked).tolist():
                near = others & (of != of[u]) & _fits(n[u], n, percent)
                near[near] = (sig[near] == sig[u]).sum(axis=1) >= enough
                if near.any():
                    live |= near
                    live[u] = True
            if live.any():
                yield from t.select(["key", "i", "j", "nid"]).filter(pa.array(live)).to_batches()

    return walk


def _exact(percent: int):
    """Lists of (key, i, j, nid, component, hashes) to a forest of links between their components, by full sets."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _lists(batches):
            nid, of = t.column("nid").to_numpy(), t.column("component").to_numpy()
            names, of, counts = np.unique(of, return_inverse=True, return_counts=True)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
            n = np.array([len(s) for s in sets])
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            values, place = np.unique(np.concatenate(sets), return_inverse=True)
            root = list(range(len(names)))

            def find(x: int, root: list = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            xs, ys = [], []
            for u in np.flatnonzero(of != counts.argmax()).tolist():
                mark = np.zeros(len(values), np.int64)
                mark[place[starts[u] : starts[u] + n[u]]] = 1
                both = np.add.reduceat(mark[place], starts)
                linked = (100 * both >= percent * (n + n[u] - both)) & (of != of[u])
                for v in np.flatnonzero(linked).tolist():
                    x, y = find(of[u]), find(of[v])
                    if x != y:
                        root[x] = y
                        xs.append(nid[u : u + 1])
                        ys.append(nid[v : v + 1])
            if xs:
                yield _edges(xs, ys)

    return walk


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, cls, text) to (nid, set), for texts that are of the class."""
    known = WordHashes()
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(at, CHUNK)
            ids, sets = [], []
            for nid, cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2)), strict=True):
                s = shingle_set(text, known)
                if len(s) and class_key(s) == cls:
                    ids.append(nid)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["nid", "hashes"])


def _similar(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = intersection(x, y)
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return confirm


class _Finder:
    """The state of one run: classes, postings, sets fetched so far and confirmed links."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int) -> None:
        bound_batches(docs.sparkSession)
        self.docs, self.percent = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), percent
        kind = self.docs.schema["id"].dataType.simpleString()
        self.rows = staged(spread(self.docs).mapInArrow(_sign, f"id {kind}, n bigint, cls binary, sig array<int>"), "signed")
        self.classes = staged(
            self.rows.where("n > 0")
            .groupBy("cls")
            .agg(F.min("id").alias("mid"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
            .withColumn("nid", F.monotonically_increasing_id()),
            "classes",
        )
        self.lists: DataFrame | None = None
        self.sets: DataFrame | None = None
        self.links: DataFrame | None = None

    def postings(self) -> DataFrame:
        """(key, nid, n, sig, blocks, own): the prefix of each class, in lists of two or more; a list's number of blocks, and
        the block that a member belongs to."""
        keys = self.classes.select("nid", F.posexplode("sig").alias("k", "v")).select(
            "nid", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long") + 2147483648).alias("key")
        )
        counts = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        common = keys.join(counts, "key").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("l"))
        prefix = COORDINATES - matches(self.percent) + 1
        many = prefix - (COORDINATES - F.size("l"))
        posted = common.where(many > 0).select("nid", F.explode(F.slice("l", F.lit(1), many)).alias("x"))
        posted = staged(
            posted.select("nid", F.col("x.key").alias("key")).join(self.classes.select("nid", "n", "sig"), "nid"), "postings"
        )
        self.lists = staged(posted.groupBy("key").agg(F.count("*").alias("c"), _blocks(F.count("*"), F.sum("n")).alias("blocks")).where("c > 1"), "lists")
        return posted.join(self.lists.drop("c"), "key").withColumn("own", _dealt("nid", "blocks"))

    def meet(self, posted: DataFrame, of: DataFrame) -> DataFrame:
        """(key, i, j, nid, n, sig): one member of each component that a long list holds, cut into blocks again."""
        long = posted.where("blocks > 1").join(of, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
        some = long.groupBy("key", "component").agg(F.min_by(F.struct("nid", "n", "sig"), "nid").alias("x")).select("key", "x.*")
        sizes = some.groupBy("key").agg(F.count("*").alias("c"), _blocks(F.count("*"), F.sum("n")).alias("blocks")).where("c > 1")
        own = _dealt("nid", "blocks")
        return some.join(sizes, "key").select("key", own.alias("i"), own.alias("j"), "nid", "n", "sig")

    def mixed(self, posted: DataFrame, of: DataFrame) -> DataFrame:
        """(key, i, j, nid, n, sig, component, few): the lists that may hold pairs of two components. Short ones are whole.
        Of long ones, the few that are not in the largest component are dealt into blocks i and go to every block j; all
        members go to their own block j, once for each i."""
        posted = posted.join(of, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
        none = F.lit(None).cast("boolean").alias("few")
        columns = ["nid", "n", "sig", "component"]
        short = posted.where("blocks = 1").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), *columns, none)
        long = posted.where("blocks > 1")
        parts = long.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        main = F.max_by("component", F.struct("c", "component"))
        most = F.max(F.struct("c", "component", "s"))
        main = parts.groupBy("key").agg(main.alias("main"), (F.sum("c") - most.c).alias("others"), (F.sum("s") - most.s).alias("sizes"))
        main = main.where("others > 0").select("key", "main", _blocks(F.col("others"), F.col("sizes")).alias("of_few"))
        long = long.join(main, "key")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        few = long.where("component <> main").select("key", _dealt("nid", "of_few").alias("i"), each("blocks").alias("j"), *columns, F.lit(True).alias("few"))
        rest = long.select("key", each("of_few").alias("i"), F.col("own").alias("j"), *columns, F.lit(False).alias("few"))
        return short.unionByName(few).unionByName(rest)

    def by_list(self, rows: DataFrame) -> DataFrame:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "nid")

    def fetch(self, nodes: DataFrame) -> DataFrame:
        """(nid, hashes) of at least these nodes. Texts are read again for those that were not fetched before; a blocked
        Bloom filter of their ids, of bounded size, keeps most other texts out of the join, which is exact."""
        fresh = nodes if self.sets is None else nodes.join(self.sets.select("nid"), "nid", "left_anti")
        fresh = staged(fresh.join(self.classes.select("nid", "cls", "mid", "copies"), "nid"), "nodes")
        many, copies = fresh.agg(F.count("*"), F.max("copies")).collect()[0]
        if many:
            ids = F.xxhash64(F.col("id"))
            docs = self.docs.where(bloom.passes(bloom.build(fresh.select(F.xxhash64("mid").alias("h")), "h", many), ids, many))
            same = F.col("d.id").eqNullSafe(F.col("w.mid"))
            texts = docs.alias("d").join(fresh.alias("w"), same).select("w.nid", "w.cls", "d.text")
            found = texts.mapInArrow(_sets, "nid bigint, hashes binary")
            if copies > 1:  # rows that repeat an id and a text give a set more than once
                found = found.groupBy("nid").agg(F.first("hashes").alias("hashes"))
            found = staged(found, "sets")
            self.sets = found if self.sets is None else self.sets.unionByName(found)
        return self.sets

    def add(self, links: DataFrame) -> None:
        links = staged(links.distinct(), "links")
        self.links = links if self.links is None else self.links.unionByName(links)

    def confirm(self, pairs: DataFrame) -> None:
        """Adds the linked ones among distinct (a, b) pairs, by full sets."""
        sets = self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct())
        both = pairs.join(sets.select(F.col("nid").alias("a"), F.col("hashes").alias("ha")), "a").join(
            sets.select(F.col("nid").alias("b"), F.col("hashes").alias("hb")), "b"
        )
        self.add(both.select("a", "b", "ha", "hb").mapInArrow(_similar(self.percent), "a bigint, b bigint"))

    def components(self) -> DataFrame:
        return staged(connected(self.links, "a", "b").withColumnRenamed("node", "nid"), "components")

    def link(self, lists: DataFrame) -> bool:
        """Adds the links of the forests of these lists; whether there was anything to confirm."""
        near = self.by_list(lists).mapInArrow(_forest(self.percent), "a bigint, b bigint").distinct()
        near = staged(near if self.links is None else near.join(self.links, ["a", "b"], "left_anti"), "near")
        if near.isEmpty():
            return False
        self.confirm(near)
        return True

    def run(self) -> None:
        posted = self.postings()
        if not self.link(posted.select("key", F.col("own").alias("i"), F.col("own").alias("j"), "nid", "n", "sig")):
            return
        of = self.components()
        if not self.lists.where("blocks > 1").isEmpty() and self.link(self.meet(posted, of)):
            of = self.components()
        live = self.by_list(self.mixed(posted, of)).mapInArrow(_live(self.percent), "key bigint, i int, j int, nid bigint")
        live = staged(live, "live")
        if live.isEmpty():
            return
        sets = self.fetch(live.select("nid").distinct())
        whole = live.join(sets, "nid").join(of, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
        self.add(self.by_list(whole).mapInArrow(_exact(self.percent), "a bigint, b bigint"))


def _blocks(members: Column, shingles: Column) -> Column:
    """Into how many blocks a list of so many members and shingles is cut."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _dealt(nid: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(nid, F.lit("block")), F.col(blocks)).cast("int")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n, component) of every row: its id, the size of its shingle set and the least id of its component."""
    run = _Finder(docs, id_col, text_col, percent)
    run.run()
    named = run.classes.select("cls", "mid", "nid")
    if run.links is not None:
        found = connected(run.links, "a", "b").withColumnRenamed("node", "nid")
        least = found.join(named, "nid").groupBy("component").agg(F.min("mid").alias("least"))
        named = named.join(found.join(least, "component").select("nid", "least"), "nid", "left")
        named = named.select("cls", F.coalesce("least", "mid").alias("component"))
    else:
        named = named.select("cls", F.col("mid").alias("component"))
    out = run.rows.where("cls IS NOT NULL").select("id", "n", "cls").join(named, "cls").select("id", "n", "component")
    # rows with the empty set, however many, don't meet in a join
    return out.unionByName(run.rows.where("cls IS NULL").select("id", "n", F.col("id").alias("component")))


def _class_keys(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known = WordHashes()
    for batch in texts:
        sets = [shingle_set(text, known) for text in batch]
        yield pd.Series([class_key(s) if len(s) else None for s in sets], dtype=object)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the columns of docs: a row of the least id, null if none has one, and of the least
    class key under it; where several rows have both, the first by its text. Only rows of one component are merged: null
    and repeated ids don't name a row, so these go by id and class. Rows with the empty set all stay, being linked with
    nothing."""
    run = _Finder(docs, id_col, text_col, percent)
    run.run()
    nodes = run.classes.select("cls", "mid", F.col("nid").alias("component"))
    if run.links is not None:
        found = connected(run.links, "a", "b").withColumnRenamed("node", "nid").withColumnRenamed("component", "c")
        nodes = run.classes.join(found, "nid", "left").select("cls", "mid", F.coalesce("c", "nid").alias("component"))
    first = nodes.groupBy("component").agg(F.min(F.struct(F.col("mid").isNull().alias("unnamed"), "mid", "cls")).alias("x"))
    first = staged(first.select("x.mid", "x.cls"), "first")
    # whether a row's id and class are those that stay
    rows = run.rows.where("cls IS NOT NULL").select("id", "cls").join(first.withColumn("best", F.lit(True)), "cls", "left")
    stays = F.coalesce(F.col("best") & F.col("id").eqNullSafe(F.col("mid")), F.lit(False))
    rows = rows.select("id", stays.alias("stays")).unionByName(run.rows.where("cls IS NULL").select("id", F.lit(True).alias("stays")))
    ids = rows.groupBy("id").agg(F.count("*").alias("c"), F.max("stays").alias("stays"))
    # ids that don't stay go as a whole, those of several rows are looked at by class, and all others stay
    asked = ids.where("id IS NOT NULL AND (NOT stays OR c > 1)").select(F.col("id").alias(P + "asked"), "stays")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    asked, of = staged(asked, "asked"), docs.withColumn(P + "id", F.col(id_col))

    def among(ids: DataFrame, many: int) -> Column:
        """A bounded Bloom filter of ids, which keeps other rows out of an exact join."""
        return bloom.passes(bloom.build(ids.select(F.xxhash64(P + "asked").alias("h")), "h", many), F.xxhash64(P + "id"), many)

    again = asked.where("stays").select(P + "asked")
    many, repeated = asked.agg(F.count("*"), F.count_if("stays")).collect()[0]
    same, named = F.col(P + "id") == F.col(P + "asked"), of.where(F.col(P + "id").isNotNull())
    kept, doubtful = named, of.where(F.col(P + "id").isNull())
    if many:
        maybe = among(asked, many)
        kept = named.where(~maybe).unionByName(named.where(maybe).join(asked, same, "left_anti"))
    if repeated:
        doubtful = doubtful.unionByName(named.where(among(again, repeated)).join(again, same, "left_semi"))
    if repeated or not run.rows.where("id IS NULL").isEmpty():
        key = F.pandas_udf(_class_keys, "binary")(F.col(f"`{text_col}`").cast("binary"))
        doubtful = doubtful.withColumn(P + "cls", key)
        one = doubtful.where(F.col(P + "cls").isNotNull()).groupBy(P + "id", P + "cls").agg(F.min_by(F.struct(*columns), F.col(f"`{text_col}`")).alias(P + "row"))
        one = one.join(first, F.col(P + "id").eqNullSafe(F.col("mid")) & (F.col(P + "cls") == F.col("cls")), "left_semi")
        one = one.select(*[F.col(P + "row").getField(c).alias(c) for c in docs.columns])
        empty = doubtful.where(F.col(P + "cls").isNull())
        kept = kept.select(*columns).unionByName(empty.select(*columns)).unionByName(one)
    return kept.select(*columns)
