"""Sharding by sampled splitters under the law `bytes`: shards of nearly equal size.

1. Every record gets a range key (by default the hash of its text, so that equal texts are neighbours) and a size.
2. A size-weighted sample of keys is drawn: a record is taken with a probability in proportion to its size, decided by a
   hash, so that reruns draw the same sample. Its quantiles are the boundaries of fine ranges; a key that fills several
   quantiles by itself gets a range of its own.
3. The ranges' exact sizes and rows are summed. A range over its share is subdivided: one with many keys by key, so that
   equal keys stay together; one with a single key only where that key alone exceeds a shard, or holds too many rows for
   one task to number. Such pieces are told apart by the records' tie-breaking hash.
4. Ranges go to shards, the largest first, each to the shard with the least so far. The table of ranges is small by
   construction, so the driver holds it; records never leave the executors.
5. A record's slot is its range's offset in the shard plus its place in the range, so no window spans a shard.

Equal keys share a shard unless their group is larger than a shard's fair share.

Defined results: a null text is not an equal of an empty one but has the size 1 as well; null ids sort first; repeated
rows take slots of their own; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Fine ranges of a shard, at least, and sampled keys of a fine range.
RANGES_PER_SHARD = 64
KEYS_PER_RANGE = 16
#: Rows of a fine range, about, since a task numbers one; and most ranges, whose table is held by the driver.
RANGE_ROWS = 1_000_000
MOST_RANGES = 65_536


def search(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are at most the key, by bisection inside one expression."""
    steps, n = [], 1
    while n <= len(bounds):
        n *= 2
    padded = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    while n >= 1:
        steps.append(n)
        n //= 2
    last = len(bounds)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= last) & (F.get(padded, at + s - 1) <= key), at + s).otherwise(at),
    )


def _boundaries(sample: list[int], n: int) -> list[int]:
    """Quantiles of the sampled keys. A key that spans quantiles is closed by its successor, so it stands alone."""
    sample.sort()
    cut = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []
    hot = {b for b, c in zip(cut, cut[1:], strict=False) if b == c}
    return sorted({*cut, *(b + 1 for b in hot if b < 2**63 - 1)})


def assign(sizes: dict[tuple, int], shards: int) -> dict[tuple, int]:
    """Largest first, each to the lightest shard; ties by name, so reruns agree."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for unit, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def by_bytes(df: DataFrame, size: Column, key: Column, tie: Column, shards: int, carry: list[Column]) -> DataFrame:
    """(carried columns, size, shard, slot) of every row of df."""
    spark = df.sparkSession
    rows = df.select(*carry, size.cast("long").alias("__size"), key.cast("long").alias("__key"), tie.cast("long").alias("__tie"))
    rows = staged(rows, "sharding")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("__size"), F.lit(0))).collect()[0]
    ranges = max(shards * RANGES_PER_SHARD, min(MOST_RANGES, n // RANGE_ROWS))
    wanted = ranges * KEYS_PER_RANGE
    # a record's chance is its size over total / wanted; one heavier than that is surely in the sample
    chance = F.col("__size") * F.lit(wanted / max(total, 1))
    drawn = (F.xxhash64("__tie", "__key", F.lit("draw")).bitwiseAND(2**53 - 1) / F.lit(float(2**53))) < chance
    times = F.greatest(F.lit(1), F.least(chance, F.lit(float(wanted)))).cast("int")
    sample = [k for r in rows.where(drawn).select("__key", times.alias("t")).collect() for k in [r[0]] * r[1]]
    rows = rows.withColumn("__range", search(_boundaries(sample, ranges), F.col("__key")))
    summed = rows.groupBy("__range").agg(
        F.sum("__size").alias("bytes"), F.count("*").alias("rows"), (F.min("__key") < F.max("__key")).alias("many")
    )
    fair, even = total / shards, max(1, n // ranges)
    parts, keys_of = {}, {}
    for r in summed.collect():
        fill = max(r["bytes"] / max(1, total / ranges), r["rows"] / even)
        parts[r["__range"]] = max(1, min(4 * ranges, int(fill / 2) + 1)) if fill > 2 else 1
        keys_of[r["__range"]] = r["many"]
    cut = {r: k for r, k in parts.items() if k > 1}
    if cut:
        table = F.create_map(*[F.lit(x) for r, k in cut.items() for x in (r, k)])
        many = F.array(*[F.lit(r) for r in cut if keys_of[r]]) if any(keys_of[r] for r in cut) else F.array().cast("array<int>")
        pieces = F.coalesce(F.try_element_at(table, F.col("__range")), F.lit(1))
        by = F.when(F.array_contains(many, F.col("__range")), F.xxhash64("__key", F.lit("cut"))).otherwise(F.xxhash64("__tie", F.lit("cut")))
        rows = rows.withColumn("__piece", F.pmod(by, pieces).cast("int"))
    else:
        rows = rows.withColumn("__piece", F.lit(0))
    rows = staged(rows, "ranges")
    units, lone = {}, defaultdict(int)
    for r in rows.groupBy("__range", "__piece").agg(F.sum("__size"), F.count("*")).collect():
        units[(r[0], r[1])] = (r[2], r[3])
        if not keys_of.get(r[0], True):
            lone[r[0]] += r[2]
    # the pieces of a single key go together unless the key outweighs a shard
    bundles = {(r, p): (r, -1) if lone.get(r, fair + 1) <= fair else (r, p) for r, p in units}
    weight: dict[tuple, int] = defaultdict(int)
    for unit, bundle in bundles.items():
        weight[bundle] += units[unit][0]
    shard_of = assign(weight, shards)
    offset, placed = defaultdict(int), []
    for unit in sorted(units):
        s = shard_of[bundles[unit]]
        placed.append((*unit, s, offset[s]))
        offset[s] += units[unit][1]
    # as many rows as there are ranges and pieces, a few times MOST_RANGES at most
    where = spark.createDataFrame(placed, "__range int, __piece int, shard int, __offset long")
    place = F.expr("row_number() OVER (PARTITION BY __range, __piece ORDER BY __key, __tie)")
    rows = rows.withColumn("__place", place.cast("long")).join(F.broadcast(where), ["__range", "__piece"])
    return rows.withColumn("slot", F.col("__offset") + F.col("__place") - 1).drop("__range", "__piece", "__place", "__offset", "__key", "__tie").withColumnRenamed("__size", "size")


def shard_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """(id, text_crc32, size, shard, slot): texts dealt out by bytes, equal texts together."""
    text = F.col(text_col)
    return by_bytes(
        df,
        size=F.coalesce(F.octet_length(text), F.lit(0)) + 1,
        key=F.xxhash64(text),
        tie=F.xxhash64(F.col(id_col), text),
        shards=shards,
        carry=[F.col(id_col).alias("id"), F.crc32(text).alias("text_crc32")],
    )
