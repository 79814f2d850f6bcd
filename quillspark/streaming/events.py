"""Streams of events. Event-time windows, watermarks and this streaming layer are this engine's own; the batch queries
(model_health, daily_cap, stale_keys, requeue_stale) carry the polling semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by type and UTC day; data more than `late` behind are dropped from windows already out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def health(events: DataFrame, bad: str = "error") -> DataFrame:
    """Counters a key, with the time of the last good and the last bad event."""
    is_bad = F.col("event_type") == bad
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_bad).alias("n_errors"), F.max(F.when(~is_bad, F.col("ts"))).alias("last_ok"), F.max(F.when(is_bad, F.col("ts"))).alias("last_error"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events with gaps below `gap`; a key without one for that long is stale."""
    w = F.session_window("ts", gap)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", w.alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("first"), F.col("s.end").alias("stale_from"), "n")
