"""Ranks, top-k, capped retention and running allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def rank_avg(value: str, by: list[str]) -> Column:
    """Mean rank of ties, largest first."""
    n = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value))) + (n - 1) / 2


def percent_rank_exc(value: str, by: list[str]) -> Column:
    over = Window.partitionBy(*by)
    return F.rank().over(over.orderBy(value)) / (F.count("*").over(over) + 1)


def kth(df: DataFrame, by: list[str], value: str, k: int, out: str, largest: bool = True) -> DataFrame:
    """(by, out): the k-th largest or smallest value of each group, repeats counted; null for groups of fewer values. Ranks
    are limited to k before rows are exchanged, so no group is gathered."""
    order = F.desc(value) if largest else F.asc(value)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    found = ranked.where(F.col("_r") == k).select(*by, F.col(value).alias(out))
    return df.select(*by).distinct().join(found, by, "left")


def placed(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with each row's place, from 1, in a total order, without one task for all: rows are dealt into ranges of the
    order, staged, numbered in their range, and a range starts behind the counts of those before it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "places")
    counts = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}  # at most `parts` rows
    before, at = [], 0
    for k in sorted(counts):
        before += [F.lit(k), F.lit(at).cast("long")]
        at += counts[k]
    if not before:
        return df.withColumn(out, F.lit(0).cast("long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.try_element_at(F.create_map(*before), F.col("_range"))
    return rows.withColumn(out, place).drop("_range")


def keep_newest(df: DataFrame, by: list[str], newest: list[Column], most: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).where(F.col("_r") <= most).drop("_r")


def allocate(df: DataFrame, by: list[str], order: list[Column], available: str, wanted: Column, out: str) -> DataFrame:
    """Spends `wanted` over the rows of a group in order, from each at most what it has."""
    before = F.coalesce(F.sum(available).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(out, F.greatest(F.lit(0), F.least(F.col(available), wanted - before)))


def burn_order(priority: str, expires: str, granted: str, name: str) -> list[Column]:
    """Priority, then the expiry in whole seconds with none last, then age, then name."""
    return [F.col(priority).asc(), F.unix_seconds(F.col(expires).cast("timestamp")).asc_nulls_last(), F.col(granted).asc(), F.col(name).asc()]


def dedupe_names(df: DataFrame, name: str, ordinal: str, joint: str = "_") -> DataFrame:
    """Repeated names get a number: the first keeps its name."""
    r = F.row_number().over(Window.partitionBy(name).orderBy(ordinal)) - 1
    return df.withColumn("unique_name", F.when(r == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(joint), r)))


def first_free_names(names: list[str]) -> list[str]:
    """Header names made unique: a repeat takes the first suffix that is not a header yet."""
    used, times, out = set(names), {}, []
    for raw in names:
        name = raw.removeprefix("﻿")
        if name in times:
            k = times[name]
            while f"{name}_{k}" in used:
                k += 1
            times[name] += 1
            used.add(f"{name}_{k}")
            out.append(f"{name}_{k}")
        else:
            times[name] = 1
            used.add(name)
            out.append(name)
    return out
