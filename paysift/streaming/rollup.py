"""Incremental monthly means over an append-only log (Structured Streaming).

The log grows by appended Parquet files (``sources.files.append_log``).  The
stream keeps one state row per (key, day window): sum and count, finalised
once the watermark passes the window end and appended to a Parquet sink.
Monthly means are a cheap batch re-aggregation of those daily partials
(sums and counts add up exactly), so late rows within the watermark are
counted and the state never holds more than the open windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def daily_partials(stream: DataFrame, ts: str, value: str, keys: Sequence[str] = (),
                   watermark: str = "2 days") -> DataFrame:
    """Streaming daily (sum, count) per key with an event-time watermark.
    Zone-less timestamps are read as session-time-zone timestamps (watermarks need them)."""
    return (stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
                  .groupBy(*keys, F.window(ts, "1 day").alias("w"))
                  .agg(F.sum(value).alias("value_sum"), F.count(value).alias("value_count"))
                  .select(*keys, F.col("w.start").alias("day_start"), "value_sum", "value_count"))


def start_daily_rollup(spark: SparkSession, source: str, schema: StructType | str, sink: str,
                       checkpoint: str, ts: str, value: str, keys: Sequence[str] = (),
                       watermark: str = "2 days", available_now: bool = True):
    """Run the rollup from ``source`` (Parquet folder) into ``sink``; returns the query.

    ``checkpoint`` must be shared storage (offsets and state survive executor
    and driver restarts).
    """
    s = spark.readStream.schema(schema).parquet(source)
    w = (daily_partials(s, ts, value, keys, watermark).writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def monthly_from_partials(partials: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Monthly mean and count from daily partials (exact: sums and counts add)."""
    return (partials.groupBy(*keys, F.date_format("day_start", "yyyy-MM").alias("month"))
                    .agg((F.sum("value_sum") / F.sum("value_count")).alias("mean"),
                         F.sum("value_count").alias("count")))
