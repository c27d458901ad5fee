"""Structured Streaming forms: event sessions, windowed counts and interval joins with late-data bounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", time: str = "ts") -> DataFrame:
    """Islands of a stream's time axis: sessions of a key that end after a gap; state goes with the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour", key: str = "event_type", time: str = "ts") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def overlapping(stream: DataFrame, intervals: DataFrame, width: int = 1024) -> DataFrame:
    """A stream of intervals against a fixed table, by the batch join's bins; no state is kept."""
    from ..operators.overlap import overlap_join

    return overlap_join(stream, intervals, width=width, tiers=1)


def latest_per_key(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """First of each key within the watermark (the stream's form of first-per-source)."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.dropDuplicatesWithinWatermark(keys) if events.isStreaming else rows.dropDuplicates(keys)
