"""Windowed event counts: the same definition for a stream and for a table at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def event_windows(events: DataFrame, every: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """(start, event_type, n, total): counts and sums per tumbling window; late events count as long as the watermark allows.

    Events without a time are dropped, since no window holds them. `late` None leaves out the watermark (batch).
    """
    e = events.filter("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "2 hours", late: str | None = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events no further apart than the gap."""
    e = events.filter("ts is not null and user_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
