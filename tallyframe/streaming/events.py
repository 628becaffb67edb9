"""Keyed event operators: replay-safe delivery and rate flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

# --- fixed values -----------------------------------------------------------
REPLAY_WINDOW = "24 hours"
RATE_WINDOW = "1 minute"
RATE_MAX = 1000
# ----------------------------------------------------------------------------



def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a ``timestamp`` column; ``timestamp_ntz`` is read as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts] == "timestamp_ntz" else df


def stream_dedupe(df: DataFrame, key: str | list[str], ts: str = "ts", window: str = REPLAY_WINDOW,
                  salts: int = 1) -> DataFrame:
    """Drops rows whose key was seen within ``window``; older rows are late and dropped.

    State per key is kept only until the watermark has passed it. A key that makes
    up much of the stream is first reduced in ``salts`` places and then once more;
    by default a key is reduced in one place at once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    out = event_time(df, ts).withWatermark(ts, window)
    if salts > 1:
        salted = out.withColumn("__salt", F.spark_partition_id() % salts)
        out = salted.dropDuplicatesWithinWatermark([*keys, "__salt"]).drop("__salt")
    return out.dropDuplicatesWithinWatermark(keys)


def rate_counts(df: DataFrame, key: str, ts: str = "ts", window: str = RATE_WINDOW,
                late: str = "10 minutes") -> DataFrame:
    """Events per key and tumbling window. Batch or stream."""
    w = F.window(ts, window)
    out = event_time(df, ts).withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events")


def rate_flags(df: DataFrame, key: str, window: str = RATE_WINDOW, max_events: int = RATE_MAX,
               ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Windows in which a key had more than ``max_events`` events. Windows are tumbling."""
    return rate_counts(df, key, ts, window, late).filter(F.col("events") > max_events)


def write_batches(df: DataFrame, out_dir: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Store a stream; a replayed micro-batch overwrites its own folder."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/rows/batch={batch_id}")

    return (df.writeStream.outputMode(mode).foreachBatch(store)
            .option("checkpointLocation", f"{out_dir}/_checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def read_batches(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/rows").drop("batch")


def latest_counts(stored: DataFrame, key: str) -> DataFrame:
    """Final count per key and window from stored updates: counts only grow."""
    return stored.groupBy(key, "window_start", "window_end").agg(F.max("events").alias("events"))
