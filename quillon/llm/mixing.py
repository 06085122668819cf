"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes are summed by source, and targets follow from the weights: shares of the whole, capped at MOST times a source's
   size, the excess shared again by weight among the others until none is above its cap.
2. Each source is cut into blocks by the hash of its records. A source gives whole epochs, then whole blocks of a
   permutation of its blocks, and of one last block the records that come first by hash, the last few of them chosen to
   close the gap: so the taken size comes near the target to a fraction of a record.
3. The blocks taken, counted by source, are split among the output shards down a binary tree: at each node the left half
   of the shards draws its number of blocks from the node's counts without replacement, a multivariate hypergeometric
   draw. Shards therefore have nearly equal numbers of blocks and unbiased mixtures, and the counts add up exactly.
4. Each shard takes the next blocks of each source's permutation, so no block is dealt twice, and a record's order in its
   shard is a hash. shuffled() deals the mix out by shard and order: that is its one exchange, into partitions of nearly
   equal size, each in its own random order.

The tables of blocks and sources have a bounded size, whatever the input: more than MOST_SOURCES sources are an error; the
driver holds the tables, and records are only ever joined with them on the map side. Which records are taken is found
without shuffling one, whatever the size of its source. Every draw comes from a fixed seed and hashes of records, so
reruns agree.

Defined results: a null text has the size 0; null sources are one source, the last; a source without words has the
target 0 and gives nothing; repeated rows with the same id, source and text are taken alike; an empty table gives an
empty result. Working columns carry a prefix, so input columns of other names survive.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, staged
from .packing import subset

P = "__mix_"
#: A target's most times of its source's size; also the most copies of a record.
MOST = 3
#: Blocks over all sources, about, and records that a block should have at least.
BLOCKS = 4096
BLOCK_RECORDS = 64
CLOSERS = 32
#: Records, about, of the last block that are put in order to find the last ones taken.
LAST_RECORDS = 4096
#: Sources, at most; their table is held by the driver.
MOST_SOURCES = 100_000
SHARDS = 16
#: Bytes of a partition of shuffled(), before it is compressed.
PART_BYTES = 128_000_000
MOST_SLICES = 10_000
SEED = 17


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def cycle_weights(sources: list[str | None]) -> dict[str | None, float]:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    inorder = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: float(1 + i % 3) for i, s in enumerate(inorder)}


def targets(sizes: dict, weights: dict, most: float = MOST) -> dict:
    """Shares of the sum of sizes by weight, none above `most` times its source's size."""
    out, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    order = list(sizes)
    while open_:
        per = left / sum(weights[s] for s in order if s in open_)
        above = [s for s in order if s in open_ and per * weights[s] > most * sizes[s]]
        if not above:
            return {s: out[s] if s in out else per * weights[s] for s in order}
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.discard(s)
        left = max(left, 0.0)
    return {s: out[s] for s in order}


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts that add up to counts: the splitting tree."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    draw = round(int(counts.sum()) * left / shards)
    rng = np.random.default_rng([SEED, seed])
    taken = rng.multivariate_hypergeometric(counts, draw, method="marginals")
    return np.concatenate([split(taken, left, 2 * seed), split(counts - taken, shards - left, 2 * seed + 1)])


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col), F.lit(SEED))


def _local(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def deal(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """df with prefixed columns: size, source_size, target, and copies, an array of (epoch, shard), one for each time
    that the mix takes the record."""
    size, key = word_count(F.col(text_col)), _key(id_col, text_col)
    rows = staged(df.select(F.col(source_col).alias("source"), size.alias("size"), key.alias("key")), "mixing")
    stats = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(stats) > MOST_SOURCES:
        raise ValueError(f"a mix of more than {MOST_SOURCES} sources")
    if not stats:
        empty = {"size": F.lit(0).cast("long"), "source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "copies": F.array().cast("array<struct<epoch:int,shard:int>>")}
        return df.withColumns({P + k: v for k, v in empty.items()})
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sources = [r["source"] for r in stats]
    words = {r["source"]: r["words"] for r in stats}
    want = targets(words, cycle_weights(sources))
    total = max(1, sum(words.values()))
    blocks = {r["source"]: int(max(1, min(BLOCKS * r["words"] // total, r["n"] // BLOCK_RECORDS))) for r in stats}
    by_source = _local(df, [(s, blocks[s], words[s], float(want[s])) for s in sources], "source string, blocks int, source_size long, target double")
    by_source = F.broadcast(by_source)

    def placed(x: DataFrame, source: str, key: Column) -> DataFrame:
        of = by_source.select(F.col("source").alias(P + "s"), *[F.col(c).alias(P + c) for c in ("blocks", "source_size", "target")])
        x = x.join(of, F.col(source).eqNullSafe(F.col(P + "s")), "left")
        return x.withColumn(P + "key", key).withColumn(P + "block", F.pmod(P + "key", P + "blocks").cast("int")).drop(P + "s", P + "blocks")

    cut = placed(rows, "source", F.col("key")).groupBy("source", P + "block").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    held: dict = defaultdict(dict)
    many = {}
    for r in cut:
        held[r["source"]][r[P + "block"]] = r["words"]
        many[r["source"], r[P + "block"]] = r["n"]
    # units: the blocks that each source gives, in order; the last of a partial epoch may be cut
    units, cuts = {}, {}
    for k, s in enumerate(sources):
        rng = np.random.default_rng([SEED, 1, k])
        names = sorted(held[s])
        full = min(MOST, int(want[s] // words[s])) if words[s] else 0
        rest = want[s] - full * words[s] if full < MOST else 0.0
        mine = [(b, e) for e in range(full) for b in rng.permutation(names).tolist()]
        if words[s] and rest >= 1:
            for b in rng.permutation(names).tolist():
                mine.append((b, full))
                if held[s][b] > rest:
                    cuts[s] = (b, full, rest)
                    break
                rest -= held[s][b]
                if rest < 1:
                    break
        units[s] = mine
    counts = split(np.array([len(units[s]) for s in sources], np.int64), shards, 1)
    shard_of: dict = defaultdict(list)
    for k, s in enumerate(sources):
        at = 0
        for shard in range(shards):
            for b, e in units[s][at : at + int(counts[shard, k])]:
                shard_of[s, b].append((e, shard))
            at += int(counts[shard, k])
    last = _last_records(placed(rows, "source", F.col("key")), cuts, many)
    table = [
        (s, b, [(e, shard, s in cuts and cuts[s][:2] == (b, e), *last.get(s, (None, None))) for e, shard in sorted(takes)])
        for (s, b), takes in shard_of.items()
    ]
    taken = _local(df, table, "source string, block int, takes array<struct<epoch:int,shard:int,cut:boolean,below:long,extra:array<bigint>>>")
    taken = F.broadcast(taken.select(F.col("source").alias(P + "s"), F.col("block").alias(P + "b"), F.col("takes").alias(P + "takes")))
    out = placed(df, source_col, key)
    out = out.join(taken, F.col(source_col).eqNullSafe(F.col(P + "s")) & (F.col(P + "block") == F.col(P + "b")), "left")
    k = F.col(P + "key")
    kept = F.filter(P + "takes", lambda t: ~t.cut | F.coalesce(k < t.below, F.lit(False)) | F.coalesce(F.array_contains(t.extra, k), F.lit(False)))
    copies = F.coalesce(
        F.transform(kept, lambda t: F.struct(t.epoch.alias("epoch"), t.shard.alias("shard"))), F.array().cast("array<struct<epoch:int,shard:int>>")
    )
    out = out.withColumns({P + "size": size, P + "copies": copies})
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[P + c for c in ("size", "source_size", "target", "copies")])


def _last_records(rows: DataFrame, cuts: dict, many: dict) -> dict:
    """Of each source's cut block: the hash below which records are taken, and those of a few more. A block of many records
    is summed up by the leading bits of their hashes, and only the range in which the sum passes the rest, LAST_RECORDS
    about, is put in order. Of the records around that place, CLOSERS on either side, the subset that comes closest is
    found."""
    if not cuts:
        return {}
    bits = {s: max(0, (many[s, b] // LAST_RECORDS).bit_length()) for s, (b, _, _) in cuts.items()}
    wanted = _local(rows, [(s, b, float(rest), 64 - bits[s]) for s, (b, _, rest) in cuts.items()], "s string, b int, rest double, shift int")
    inside = rows.join(F.broadcast(wanted), F.col("source").eqNullSafe(F.col("s")) & (F.col(P + "block") == F.col("b")))
    range_ = F.when(F.col("shift") < 64, F.expr(f"shiftright(`{P}key`, shift)")).otherwise(F.lit(0).cast("long"))
    # records of equal hash are repeated rows and are taken together
    inside = inside.groupBy("source", "rest", range_.alias("range"), F.col(P + "key").alias("key")).agg(F.sum("size").alias("size"))
    inside = staged(inside, "cut")
    sums = inside.groupBy("source", "rest", "range").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("sum", F.expr("sum(words) OVER (PARTITION BY source ORDER BY range)"))
    at = F.coalesce(F.min(F.when(F.col("sum") > F.col("rest"), F.struct("range", (F.col("sum") - F.col("words")).alias("before")))), F.max(F.struct("range", (F.col("sum") - F.col("words")).alias("before"))))
    at = sums.groupBy(F.col("source").alias("name")).agg(at.alias("at")).select("name", F.col("at.range").alias("last"), "at.before")
    near = inside.join(at, F.col("source").eqNullSafe(F.col("name")) & (F.col("range") == F.col("last")))
    over = "OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    near = near.withColumns({"sum": F.expr(f"before + sum(size) {over}"), "r": F.expr(f"row_number() {over}")})
    near = near.withColumn("m", F.expr("count_if(sum <= rest) OVER (PARTITION BY source)"))
    near = near.where((F.col("r") > F.col("m") - CLOSERS) & (F.col("r") <= F.col("m") + CLOSERS))
    found: dict = defaultdict(list)
    for r in sorted(near.collect(), key=lambda r: r["r"]):
        found[r["source"]].append(r)
    out = {}
    for s, around in found.items():
        gap = round(cuts[s][2] - (around[0]["sum"] - around[0]["size"]))
        by_size: dict = defaultdict(list)
        for r in reversed(around):
            by_size[r["size"]].append(r["key"])
        chosen = subset({n: len(k) for n, k in by_size.items() if n}, max(gap, 0))
        out[s] = (around[0]["key"], [by_size[n].pop() for n, c in chosen.items() for _ in range(c)])
    return out


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """The mix: a row of df for each copy taken, with the prefixed columns shard and order, the place in its shuffle."""
    dealt = deal(df, id_col, source_col, text_col, shards)
    one = dealt.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(P + "copies").alias(P + "copy"))
    order = F.xxhash64(F.col(id_col), F.col(text_col), F.col(P + "copy.epoch"), F.col(P + "copy.shard"))
    return one.withColumns({P + "shard": F.col(P + "copy.shard"), P + "order": order}).drop(P + "copy")


def slices_for(df: DataFrame, text_col: str = "text", shards: int = SHARDS) -> int:
    """Into how many slices of PART_BYTES of text, about, a shard of the mix of df is cut; a mix is as large as its input.
    The planner's estimate is no guide here, as it multiplies the sizes of joined tables."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).collect()[0][0]
    return max(1, min(MOST_SLICES, -(-size // (shards * PART_BYTES))))


def shuffled(mixed: DataFrame, slices: int, shards: int = SHARDS) -> DataFrame:
    """The mix in its shards, each in its own random order. Orders are hashes, so equal slices of their range hold nearly
    equal numbers of records: each slice of a shard is a partition, and no sample has to be drawn for that."""
    # the highest 31 bits of the order, in the order of signed numbers, times the slices
    high = F.shiftright(P + "order", 33).cast("long") + F.lit(2**30)
    part = F.col(P + "shard") * slices + F.shiftright(high * slices, 31).cast("int")
    return mixed.repartitionById(shards * slices, part).sortWithinPartitions(P + "shard", P + "order")
