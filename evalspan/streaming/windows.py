"""Event-time windows: the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspan.functions.columns import r6


def _timed(events: DataFrame, lateness: str | None) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    return timed.withWatermark("ts", lateness) if lateness and events.isStreaming else timed


def tumbling_stats(events: DataFrame, width: str, lateness: str | None = "1 hour") -> DataFrame:
    """Events and mean value per window and type; a stream drops windows that the watermark has passed."""
    g = _timed(events, lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "mean_value")


def session_activity(events: DataFrame, gap: str, lateness: str | None = "1 hour") -> DataFrame:
    """Events of a user without a pause of ``gap``."""
    g = _timed(events, lateness).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))
    return g.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n", "total")
