"""Event-time windows; batch and stream share the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums per hour and type: ``hour, event_type, n, total``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def stream_table(spark: SparkSession, folder: str, schema: str):
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)
