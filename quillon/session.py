"""Session construction and table access shared by queries, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: str | int = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine runs; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillon")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; zone-less timestamps become session-zone timestamps (the zone is UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Expose input tables as temporary views so that a query can be written in SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def sample_dir(scale: str = "0.001") -> str:
    return os.path.join("/root/testdata", f"sf{scale}")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the folder that all executors share; in a temporary folder of our own if none is set and
    driver and executors are one process."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/work/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back, which ends its lineage there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
