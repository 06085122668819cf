"""Lookups: exact with the first or last match, nearest smaller or larger key, and wildcard patterns.

An exact lookup first reduces the table to one row per key, so the join is many-to-one and can't multiply rows; the
planner picks the join strategy from the sizes. A nearest lookup is a union of both sides and one running window per
group: a sort, not a nested loop, so it stays linear at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import placed

#: Patterns that are held in memory of every task; more are left to the planner.
MOST_PATTERNS = 10_000


def first_match(table: DataFrame, key: str, ordinal: str, last: bool = False) -> DataFrame:
    """One row per key: that with the least ordinal, or with the greatest."""
    rest = [c for c in table.columns if c != key]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.col(ordinal))
    return table.groupBy(key).agg(pick.alias("_m")).select(key, "_m.*")


def exact(df: DataFrame, table: DataFrame, on: str, key: str, value: str, ordinal: str, out: str, default=None, last: bool = False) -> DataFrame:
    """Adds the value of the first (or last) row of table whose key equals df's; else the default."""
    dim = first_match(table.select(key, value, ordinal), key, ordinal, last).select(F.col(key).alias("_k"), F.col(value).alias(out), F.lit(True).alias("_hit"))
    joined = df.join(dim, df[on] == F.col("_k"), "left").drop("_k")
    if default is not None:
        joined = joined.withColumn(out, F.when(F.col("_hit"), F.col(out)).otherwise(F.lit(default)))
    return joined.drop("_hit")


def nearest(df: DataFrame, table: DataFrame, at: str, key: str, value: str, out: str, by: list[str] | None = None, larger: bool = False) -> DataFrame:
    """Adds the value at the greatest key not above `at`, or the least key not below it, within groups `by`; null if none.
    Among equal keys the greatest value counts."""
    by = by or []
    own = [F.col(c) for c in df.columns]
    left = df.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).cast(table.schema[value].dataType).alias("_v"))
    right = table.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(key).cast(df.schema[at].dataType).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    order = [F.col("_at").desc() if larger else F.col("_at").asc(), F.col("_side").asc(), F.col("_v").asc_nulls_first()]
    over = Window.partitionBy(*[f"_{c}" for c in by]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right.where(F.col("_at").isNotNull()))
    found = both.withColumn(out, F.last("_v", ignorenulls=True).over(over)).where("_side = 1")
    return found.select("_row.*", out)


def global_row_number(df: DataFrame, ordinal: str, out: str) -> DataFrame:
    """df numbered from 1 by a unique ordinal."""
    return placed(df, [F.col(ordinal).asc()], out)


def wildcard(df: DataFrame, patterns: DataFrame, text: str, pattern: str, ordinal: str, value: str, out: str) -> DataFrame:
    """Adds the value of the first pattern, by ordinal, that a text matches. Patterns are a small rule table: the join is
    on a condition, so the planner holds the patterns in memory and streams df past them."""
    few = patterns.limit(MOST_PATTERNS + 1).count() <= MOST_PATTERNS
    keyed = df.withColumn("_id", F.monotonically_increasing_id())
    hit = keyed.join(F.broadcast(patterns) if few else patterns, F.regexp_like(F.col(text), F.col(pattern)), "left")
    pick = F.min_by(F.col(value), F.col(ordinal)).alias(out)
    return hit.groupBy("_id", *df.columns).agg(pick).drop("_id")


def position(table: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, position): where each key first stands, from 1, in the table's order."""
    first = table.groupBy(key).agg(F.min(ordinal).alias("_o"))
    places = global_row_number(table.select(ordinal), ordinal, "position")
    return first.join(places, F.col("_o") == F.col(ordinal)).select(key, "position")


def is_same(pairs: list[tuple[str, str]]) -> Column:
    """Whether all pairs of columns are equal, nulls being equal to nulls."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out
