"""Grouped outcome reports: counts per verdict, refusal share and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .registry import Registry

registry = Registry()


@registry.query(
    "d18_group_report",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n,
           count(*) FILTER (WHERE l_discount >= 0.05) AS discounted,
           count(*) FILTER (WHERE l_discount >= 0.05) * 1.0 / count(*) AS discounted_share,
           quantile_disc(l_quantity, 0.95) AS p95_quantity
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    hit = F.count_if(F.col("l_discount") >= 0.05)
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        hit.alias("discounted"),
        (hit / F.count("*")).alias("discounted_share"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity)").alias("p95_quantity"),
    )
