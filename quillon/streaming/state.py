"""Stateful logic by key, on batches and on streams: token buckets, windowed counts, deduplication with a watermark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def token_bucket(df: DataFrame, key: str, name: str, micros: str, capacity: float, per_second: float) -> DataFrame:
    """(name, admitted): a bucket per key, full at first, refilled with time, one token a request. Requests of a key are
    walked in order; a key's requests in one batch are one group."""
    kind = df.schema[name].dataType.simpleString()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([micros, name])
        tokens, last, out = capacity, None, []
        for t in pdf[micros]:
            if last is not None:
                tokens = min(capacity, tokens + (t - last) / 1e6 * per_second)
            last = t
            out.append(tokens >= 1)
            tokens -= tokens >= 1
        return pd.DataFrame({name: pdf[name].to_numpy(), "admitted": out})

    return df.select(key, name, micros).groupBy(key).applyInPandas(walk, f"{name} {kind}, admitted boolean")


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts per type and UTC day; the same on a batch and, with a watermark, on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def burn_windows(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Errors and requests per sliding window of six hours."""
    bad = (F.col("event_type") == "error").cast("int")
    return events.withWatermark("ts", late).groupBy(F.window("ts", "6 hours", "1 hour").alias("w")).agg(F.sum(bad).alias("bad"), F.count("*").alias("total"))


def first_only(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and gives its result as a table; offsets and state are kept in the given
    folder, so a run that is broken off goes on from there. Appended rows are as many as the input's: they go as Parquet to
    a folder beside it, and only aggregates, which "complete" stands for, are held by the driver. Keys that an appending
    stream remembers are kept by RocksDB, outside the heap."""
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        rows, conf = f"{checkpoint}-rows", stream.sparkSession.conf
        before = conf.get(STORE, None)
        conf.set(STORE, ROCKSDB)
        try:
            running = writer.format("parquet").start(rows)  # takes its own copy of the settings
        finally:
            conf.unset(STORE) if before is None else conf.set(STORE, before)
        running.awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(rows)
    writer.format("memory").start().awaitTermination()
    return stream.sparkSession.table(name)
