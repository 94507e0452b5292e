"""Queries of the event windows at rest, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from ..streaming import windows


def event_windows(s: SparkSession, d: str) -> DataFrame:
    w = windows.event_windows(table(s, d, "events"), late=None)
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(s: SparkSession, d: str) -> DataFrame:
    w = windows.user_sessions(table(s, d, "events"), late=None)
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("first_ts"), "n")


QUERIES = {f.__name__: f for f in (event_windows, user_sessions)}

SQL = {
    "event_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by all",
    "user_sessions": """with g as (select user_id, ts, case when ts < lag(ts) over w + interval 2 hour then 0 else 1 end as new from events where ts is not null and user_id is not null window w as (partition by user_id order by ts)),
  k as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as i from g) select user_id, min(ts) as first_ts, count(*) as n from k group by user_id, i""",
}
