"""Operators that run alike on a table and on a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, *, late: str = "24 hours") -> DataFrame:
    """Events with a proper timestamp and, on a stream, a watermark for late ones."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(start, total, errors) of each window of event time."""
    counted = timed(events).groupBy(F.window("ts", width)).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "total", "errors")


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of each user's events with pauses below ``gap``."""
    counted = timed(events).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def first_seen(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Events without repeats of a key; on a stream, within the watermark."""
    events = timed(events)
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
