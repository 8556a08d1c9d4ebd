"""Event-time counterparts of the window and run operators: an extension on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", slide: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Count and sum per key and sliding window; rows later than ``late`` are dropped by the watermark on a stream."""
    x = events.withWatermark(ts, late) if events.isStreaming else events
    w = x.groupBy(F.window(ts, size, slide), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a key's events with no pause of ``gap`` or more."""
    x = events.withWatermark(ts, late) if events.isStreaming else events
    s = x.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
