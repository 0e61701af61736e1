"""Structured Streaming over run telemetry: windowed rates and exactly-once resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and mean of `value` per window and event_type; rows later than `late` are dropped with their state."""
    return _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: start, end and number of events."""
    return _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unique(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what is there and stops; run again with the same checkpoint it goes on where it stopped."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
