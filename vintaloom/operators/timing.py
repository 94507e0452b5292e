"""Calendar spines, decision ledgers and training windows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.months import add_month, index_month, month_index

ZONE = "America/New_York"


def spine(df: DataFrame, entity: Sequence[str], month: str) -> DataFrame:
    """Insert the absent months between each entity's first and last, as rows with NULL in other columns."""
    i = month_index(F.col(month))
    full = df.groupBy(*entity).agg(F.min(i).alias("a"), F.max(i).alias("b")).filter("a is not null").select(*entity, F.explode(F.sequence("a", "b")).alias("i")).select(*entity, index_month(F.col("i")).alias(month))
    return full.join(df, [*entity, month], "left")


def latest_before(months: DataFrame, vintages: DataFrame, lag: int, fixed: str | None = None) -> DataFrame:
    """(month, vintage): the latest of the vintages not later than month - lag, or the `fixed` one if it is among them; NULL if there is none.

    Both lists are bounded by the calendar.
    """
    v = vintages.select(F.col("vintage_month").alias("vintage")).distinct()
    m = months.select("month").distinct()
    if fixed is not None:
        return m.withColumn("want", F.lit(fixed)).join(v, F.col("want") == F.col("vintage"), "left").select("month", "vintage")
    both = m.select("month", add_month(F.col("month"), -lag).alias("at"), F.lit(None).cast("string").alias("vintage")).unionByName(v.select(F.lit(None).cast("string").alias("month"), F.col("vintage").alias("at"), "vintage"))
    known = F.max("vintage").over(W.orderBy("at", F.col("month").isNotNull()).rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("known", known).filter("month is not null").select("month", F.col("known").alias("vintage"))


def training_windows(decisions: DataFrame, month: str, train: int = 48, lag: int = 2) -> DataFrame:
    """The rows a decision learns from: targets month-train-1 .. month-2 with their predictor and condition base months."""
    m = F.col(month)
    out = decisions.select(m, F.explode(F.sequence(F.lit(-train - 1), F.lit(-2))).alias("o")).withColumn("target_month", index_month(month_index(m) + F.col("o")))
    return out.select(month, (F.col("o") + train + 1).alias("position"), "target_month", add_month(F.col("target_month"), -lag - 1).alias("predictor_base_month"), add_month(F.col("target_month"), -lag).alias("condition_base_month"))


def forward_folds(decisions: DataFrame, month: str, train: int = 48, first: int = 23) -> DataFrame:
    """Expanding inner windows of a decision: fold k holds the first `first` + k targets and is tried on the target two months later.

    The last fold is tried on month - 2, the last target whose return has ended at the decision: 24 folds of
    23 to 46 rows for 48 training rows.
    """
    f = decisions.select(month, F.explode(F.sequence(F.lit(0), F.lit(train - 2 - first))).alias("fold")).withColumn("rows", F.col("fold") + first)
    start = month_index(F.col(month)) - train - 1
    return f.select(month, "fold", "rows", index_month(start).alias("first_target"), index_month(start + F.col("rows") - 1).alias("last_target"), index_month(start + F.col("rows") + 1).alias("validation_month"))


def first_sessions(sessions: DataFrame) -> DataFrame:
    """(month, session): the first session of every month of a session list."""
    return sessions.filter("session is not null").groupBy(F.substring("session", 1, 7).alias("month")).agg(F.min("session").alias("session"))


def decision_time(session: Column) -> Column:
    """09:00 in New York on the session, as a UTC instant."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(session, F.lit(" 09:00:00"))), ZONE)


def assumed_available_at(vintage: Column, lag: int) -> Column:
    """00:00 in New York on the first day of the month `lag` after the vintage, as a UTC instant."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(add_month(vintage, lag), F.lit("-01 00:00:00"))), ZONE)


def holding_days(start: Column, end: Column) -> Column:
    """New York calendar days between two UTC instants; clock changes don't count."""
    local = lambda t: F.to_date(F.from_utc_timestamp(t.cast("timestamp"), ZONE))
    return F.date_diff(local(end), local(start))


def closing_time(session: Column, close_hour: Column | int = 16) -> Column:
    """The session's close in New York as a UTC instant."""
    hour = F.lit(close_hour) if isinstance(close_hour, int) else close_hour
    return F.to_utc_timestamp(F.to_timestamp(F.concat(session, F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00:00"))), ZONE)


def month_days(sessions: DataFrame) -> DataFrame:
    """(month, days): calendar days from the first session of a month to that of the next, in New York."""
    f = first_sessions(sessions)
    w = W.orderBy("month")  # bounded by the calendar
    follows = month_index(F.lead("month").over(w)) == month_index(F.col("month")) + 1
    return f.select("month", F.when(follows, F.date_diff(F.lead("session").over(w).cast("date"), F.col("session").cast("date"))).alias("days")).filter("days is not null")


def decision_ledger(decisions: DataFrame, vintages: DataFrame, sessions: DataFrame, month: str = "month", train: int = 48, lag: int = 2, fixed: str | None = None) -> DataFrame:
    """One row a decision month: its instants, vintage, cutoff and training rows, and whether each timing rule holds.

    sessions: (session, close_hour) of the exchange. Decisions fall at 09:00 of the month's first session, which
    closes the trades; a target's return runs from close to close of first sessions. Rules: every target's
    return ends before the decision, no base month is after the cutoff, the vintage is available before the
    decision (NULL for a fixed vintage, which is an ex-post comparison).
    """
    first = sessions.withColumn("m", F.substring("session", 1, 7)).groupBy("m").agg(F.min_by(F.struct("session", "close_hour"), "session").alias("s"))
    at = first.select("m", decision_time(F.col("s.session")).alias("decision_at"), closing_time(F.col("s.session"), F.col("s.close_hour")).alias("closes_at"), F.col("s.session").alias("session"))
    rows = training_windows(decisions, month, train, lag)
    start = at.select(F.col("m").alias("target_month"), F.col("closes_at").alias("target_start_at"))
    end = at.select(add_month(F.col("m"), -1).alias("target_month"), F.col("closes_at").alias("target_end_at"))
    rows = rows.join(start, "target_month", "left").join(end, "target_month", "left")
    grouped = rows.groupBy(month).agg(
        F.array_sort(F.collect_list(F.struct("position", "target_month", "predictor_base_month", "condition_base_month", "target_start_at", "target_end_at"))).alias("training_rows"),
        F.max("target_end_at").alias("_ended"), F.count_if(F.col("target_end_at").isNull()).alias("_open"), F.greatest(F.max("condition_base_month"), F.max("predictor_base_month")).alias("_base"), F.count("*").alias("n_rows"),
    )
    known = latest_before(decisions.select(F.col(month).alias("month")), vintages, lag, fixed).withColumnRenamed("month", month)
    own = at.select(F.col("m").alias(month), "session", "decision_at", F.col("closes_at").alias("execution_at"))
    out = grouped.join(known, month).join(own, month, "left").join(at.select(add_month(F.col("m"), -1).alias(month), F.col("closes_at").alias("target_end_at")), month, "left")
    available = assumed_available_at(F.col("vintage"), lag)
    return out.withColumn("cutoff", add_month(F.col(month), -lag - 1)).select(
        month, "session", "decision_at", "execution_at", "target_end_at", "vintage", available.alias("available_at"), "cutoff", "n_rows", "training_rows",
        F.coalesce((F.col("_open") == 0) & (F.col("_ended") < F.col("decision_at")), F.lit(False)).alias("targets_ended"), (F.col("_base") <= F.col("cutoff")).alias("bases_known"),
        (F.lit(None).cast("boolean") if fixed is not None else F.coalesce(available < F.col("decision_at"), F.lit(False))).alias("vintage_available"),
    )


def _easter(year: int) -> dt.date:
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    d = dt.date(year, month, 1)
    d += dt.timedelta((weekday - d.weekday()) % 7 + 7 * (n - 1))
    return d


def exchange_holidays(year: int) -> set[dt.date]:
    """Weekday holidays of the New York exchange under its present rules, from 1990 on, without unscheduled closures but those listed."""
    memorial = max(d for d in (dt.date(year, 5, 25) + dt.timedelta(i) for i in range(7)) if d.weekday() == 0)
    fixed = [dt.date(year, 7, 4), dt.date(year, 12, 25), *([dt.date(year, 6, 19)] if year >= 2022 else [])]
    days = {_nth(year, 2, 0, 3), _easter(year) - dt.timedelta(2), memorial, _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), *([_nth(year, 1, 0, 3)] if year >= 1998 else [])}
    days |= {d - dt.timedelta(1) if d.weekday() == 5 else d + dt.timedelta(1) if d.weekday() == 6 else d for d in fixed}
    new_year = dt.date(year, 1, 1)
    days |= {new_year + dt.timedelta(1)} if new_year.weekday() == 6 else {new_year} if new_year.weekday() < 5 else set()
    # Days the exchange stayed closed outside its rules.
    extra = ["1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"]
    return days | {d for d in map(dt.date.fromisoformat, extra) if d.year == year}


def exchange_sessions(spark: SparkSession, first: int = 1990, last: int = 2035) -> DataFrame:
    """(session, close_hour): trading days of the New York exchange; half days close at 13 (the day after Thanksgiving, Christmas Eve, the day before Independence Day)."""
    rows = []
    for year in range(first, last + 1):
        closed = exchange_holidays(year)
        half = {_nth(year, 11, 3, 4) + dt.timedelta(1), dt.date(year, 12, 24), dt.date(year, 7, 3)}
        day = dt.date(year, 1, 1)
        while day.year == year:
            if day.weekday() < 5 and day not in closed:
                rows.append((day.isoformat(), 13 if day in half else 16))
            day += dt.timedelta(1)
    return spark.createDataFrame(rows, "session string, close_hour int")
