"""Metrics over events: cumulative histograms, interpolated quantiles, burn rates, reset-aware increases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: histogram edges, in seconds
REQUEST_EDGES = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0, 300.0]


def histogram(df: DataFrame, by: list[str], value: str, edges: list[float]) -> DataFrame:
    """(by, le, n): how many values are at most each edge, and all of them under infinity. Values are counted per bucket
    first, one small row per group and edge; only these are summed up."""
    bucket = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        bucket = F.when(F.col(value) <= edges[i], i).otherwise(bucket)
    counts = df.groupBy(*by).agg(*[F.count_if(bucket <= i).alias(f"_{i}") for i in range(len(edges) + 1)])
    rows = F.array(*[F.struct(F.lit(float(e)).alias("le"), F.col(f"_{i}").alias("n")) for i, e in enumerate([*edges, float("inf")])])
    return counts.select(*by, F.inline(rows))


def histogram_quantile(hist: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by, quantile): the rank is placed linearly in its bucket; beyond the last edge it is that edge."""
    order = Window.partitionBy(*by).orderBy("le")
    total = F.max("n").over(Window.partitionBy(*by))
    h = hist.withColumns({"_low": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "_before": F.coalesce(F.lag("n").over(order), F.lit(0)), "_rank": total * F.lit(q)})
    hit = h.where("n >= _rank AND n > 0").groupBy(*by).agg(F.min_by(F.struct("le", "_low", "_before", "n", "_rank"), "le").alias("b"))
    b = lambda c: F.col(f"b.{c}")
    inside = b("_low") + (b("le") - b("_low")) * (b("_rank") - b("_before")) / F.nullif(b("n") - b("_before"), F.lit(0))
    return hit.select(*by, F.when(b("le") == float("inf"), b("_low")).otherwise(inside).alias("quantile"))


def increase(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """df with the growth of a counter since its last row; a drop is a restart from zero."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(at))
    grown = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return df.withColumn("increase", grown)


def burn_rate(bad: Column, total: Column, objective: float) -> Column:
    """How many times faster than allowed an error budget goes."""
    return F.when(total > 0, (bad / total) / F.lit(1 - objective))


def outcome(status: Column) -> Column:
    return F.when(status < 400, "ok").when(status == 504, "timed_out").when(status < 500, "refused").otherwise("failed")


def on_list(value: Column, allowed: list[str], fallback: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(fallback))
