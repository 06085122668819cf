"""Shared pieces of the corpus operators: staged tables in the shared folder and column hygiene."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Word and white-space classes of the contracts; white space is space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Where it is unset, a folder of our own, if
    driver and executors are one process; on a cluster that is an error, since no folder of one machine is shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillon-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that Spark itself uses for it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder, removed when the driver ends normally."""
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"

    def at_end() -> None:
        if spark.sparkContext._jsc is not None:
            drop_path(spark, path)

    atexit.register(at_end)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: its lineage ends there, and a lost executor
    costs nothing that was computed before."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows, at most, that go to Python at once. Texts may be long, and both sides hold a batch in memory.
BATCH_ROWS = 512


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the rows of an Arrow batch, if it is above ours."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


#: Bytes for each core, below which a table is too small to be left in the splits of its files.
SPREAD_BYTES = 2_000_000


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if the planner's estimate says that it is so small that its few row groups would leave most of
    them idle; larger tables stay in the splits of their files and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df
