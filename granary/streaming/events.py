"""Streams: resumable logs and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; works on batches and streams alike."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _timed(events).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def append_once(stream: DataFrame, path: str, checkpoint: str, key: list[str], late: str = "1 day"):
    """Appends each key once; the checkpoint lets a restarted query go on where it stopped."""
    return _timed(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark(key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
