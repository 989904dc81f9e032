"""Demand from a stream of events: watermarked windows, and an append-only query log. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", width: str = "1 day", watermark: str | None = "2 hours") -> DataFrame:
    """``start, event_type, n`` for each window; works on tables and streams.

    Rows later than the watermark are dropped by the stream; rows without a time are in no window.
    """
    rows = events.withWatermark(time, watermark) if watermark else events
    counts = rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), kind, "n")


def decayed_demand(counts: DataFrame, now: str, half_life_days: float, kind: str = "event_type") -> DataFrame:
    """Demand of each kind from windowed counts, halved every ``half_life_days``."""
    from sievebench.operators.demand import responsibility_demand

    aged = counts.filter(F.col("start") <= F.lit(now).cast("timestamp")).select(F.col(kind).alias("component"), F.col("n").cast("double").alias("gamma"), (F.unix_seconds("start") / 86400.0).alias("ts"))
    return responsibility_demand(aged, half_life_days)


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def write_counts(counts: DataFrame, path: str, checkpoint: str):
    """Appends closed windows to a parquet folder; returns the running query."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
