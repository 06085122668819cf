"""Comparing two states of one thing: a listing with a store, a run with its baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A listing that lacks more than this share of the stored rows is not believed, from so many stored rows on.
MAX_MISSING_SHARE, MIN_FOR_SHARE = 0.5, 4


def reconcile(listed: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action): same, correct, missing (stored but not listed) or new."""
    l = listed.select(F.col(key), F.struct(*fields).alias("_l"))  # noqa: E741
    s = stored.select(F.col(key), F.struct(*fields).alias("_s"))
    action = (
        F.when(F.col("_l").isNull(), "missing")
        .when(F.col("_s").isNull(), "new")
        .when(F.col("_l").eqNullSafe(F.col("_s")), "same")
        .otherwise("correct")
    )
    return l.join(s, key, "full_outer").select(key, action.alias("action"))


def missing_guard(listed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """One row: how many are stored, listed and missing, and whether the listing is refused as incomplete."""
    n = stored.agg(F.count("*").alias("stored"))
    m = listed.agg(F.countDistinct(key).alias("listed"))
    gone = stored.join(listed.select(key), key, "left_anti").agg(F.count("*").alias("missing"))
    one = n.join(m, how="cross").join(gone, how="cross")  # three single rows
    refused = (F.col("missing") > 0) & (
        (F.col("listed") == 0) | ((F.col("stored") >= MIN_FOR_SHARE) & (F.col("missing") > F.col("stored") * MAX_MISSING_SHARE))
    )
    return one.withColumn("refused", refused)


def gate(current: DataFrame, baseline: DataFrame, key: str, value: str, higher_is_better: bool, absolute: float, relative: float) -> DataFrame:
    """(key, base, current, allowed, worse_by, verdict): missing, unbaselined, worse, improved or ok."""
    c = current.select(F.col(key), F.col(value).alias("current"), F.lit(True).alias("_c"))
    b = baseline.select(F.col(key), F.col(value).alias("base"), F.lit(True).alias("_b"))
    allowed = F.greatest(F.lit(float(absolute)), F.lit(float(relative)) * F.abs("base"))
    worse = F.col("base") - F.col("current") if higher_is_better else F.col("current") - F.col("base")
    verdict = (
        F.when(F.col("_b").isNull(), "unbaselined")
        .when(F.col("_c").isNull() | F.col("current").isNull(), "missing")
        .when(worse > allowed + 1e-9, "worse")
        .when(-worse > allowed + 1e-9, "improved")
        .otherwise("ok")
    )
    return b.join(c, key, "full_outer").select(key, "base", "current", allowed.alias("allowed"), worse.alias("worse_by"), verdict.alias("verdict"))
