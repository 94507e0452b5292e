"""Checks that a table keeps its contract, and joins that insist on it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or hold a NULL, with their count."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter((F.col("n_rows") > 1) | null)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df itself, or ContractError if a key column is absent or key_violations isn't empty."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ContractError(f"no column {missing}")
    bad = key_violations(df, keys).limit(1).collect() if keys else []
    if bad:
        raise ContractError(f"key {keys} is not unique or NULL: {bad[0].asDict()}")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], partition: str | None = None) -> DataFrame:
    """One-to-one join: both key sets must be unique and equal, and `partition`, if given, equal on both sides.

    Right columns that clash get the suffix _right. One aggregation over both sides finds every fault, so the check costs one shuffle.
    """
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    bad = sides.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).filter((F.col("l") != 1) | (F.col("r") != 1) | null).limit(1).collect()
    if bad:
        raise ContractError(f"keys don't match one to one: {bad[0].asDict()}")
    renamed = right.select(*[F.col(c).alias(c if c in keys or c not in left.columns else f"{c}_right") for c in right.columns])
    out = left.join(renamed, list(keys))
    if partition is not None and not out.filter(~F.col(partition).eqNullSafe(F.col(f"{partition}_right"))).isEmpty():
        raise ContractError(f"{partition} differs between the sides")
    return out


def missing_cells(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """(rows, cols) pairs absent from a panel that should hold every one of its row keys with every column key.

    The column keys of a panel (series, tickers, models) are few: each row key's set of them is taken from the
    whole set, which is one row, so only missing pairs are ever made.
    """
    held = df.filter(F.col(rows).isNotNull()).groupBy(rows).agg(F.collect_set(cols).alias("_held"))
    every = df.agg(F.collect_set(cols).alias("_all"))
    return held.join(F.broadcast(every), how="cross").select(rows, F.explode(F.array_except("_all", "_held")).alias(cols))


def null_without_reason(df: DataFrame, value: str, reason: str, by: Sequence[str]) -> DataFrame:
    """Per group: NULLs of `value`, and how many of them have no reason."""
    null = F.col(value).isNull()
    silent = null & (F.coalesce(F.trim(reason), F.lit("")) == "")
    return df.groupBy(*by).agg(F.count_if(null).alias("nulls"), F.count_if(silent).alias("unexplained"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: n_rows and, for each rule, the rows that break it (a NULL outcome breaks it too)."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def price_rules(tolerance: float = 1e-8) -> dict[str, Column]:
    """What a price row must satisfy."""
    f = F.col
    finite = lambda c: f(c).isNotNull() & ~F.isnan(c) & (F.abs(f(c)) < float("inf"))
    prices = ["open", "high", "low", "close", "adj_close"]
    both = lambda g: reduce(lambda a, b: a & b, [g(c) for c in prices])
    return {
        "bad_price": both(lambda c: finite(c) & (f(c) > 0)), "bad_volume": finite("volume") & (f("volume") >= 0),
        "bad_high": f("high") >= F.greatest("open", "close", "low") - tolerance, "bad_low": f("low") <= F.least("open", "close", "high") + tolerance,
        "not_final": f("finalized"),
    }


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, as often as they are lacking, with side 'left' or 'right'."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def overlay(history: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History with rows replaced by updates of the same key, and new keys added."""
    return history.join(updates.select(*keys).distinct(), list(keys), "left_anti").unionByName(updates, allowMissingColumns=True)


def common_to_all(rows: DataFrame, by: Sequence[str], variant: str, key: str) -> DataFrame:
    """(by, key): the keys that every variant of a group holds (INTERSECT over any number of variants, in one aggregation each)."""
    one = rows.select(*by, variant, key).distinct()
    n = one.groupBy(*by).agg(F.count_distinct(variant).alias("_n")) if by else one.agg(F.count_distinct(variant).alias("_n"))
    held = one.groupBy(*by, key).agg(F.count(variant).alias("_held"))
    joined = held.join(n, list(by)) if by else held.join(n, how="cross")
    return joined.filter("_held = _n").select(*by, key)


def domain_violations(df: DataFrame, domains: dict[str, Sequence]) -> DataFrame:
    """(column, value, n_rows): values outside a column's domain; NULL counts as outside."""
    one = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.coalesce(F.col(c).isin(list(ok)), F.lit(False)).alias("ok")) for c, ok in domains.items()]
    return df.select(F.explode(F.array(*one)).alias("x")).filter("not x.ok").groupBy("x.column", "x.value").agg(F.count("*").alias("n_rows"))


def panel_faults(rows: DataFrame, by: Sequence[str], expected: dict[str, Sequence[str]]) -> DataFrame:
    """(by, column values, fault): cells 'missing' from or 'unexpected' in what should hold every combination of the expected values, and 'repeated' ones.

    The expected combinations are a parameter; they are exploded from each group, so no group is gathered.
    """
    names = list(expected)
    want = rows.select(*by).distinct()
    for c in names:
        want = want.withColumn(c, F.explode(F.array(*[F.lit(v) for v in expected[c]])))
    have = rows.groupBy(*by, *names).agg(F.count("*").alias("_n"))
    j = want.withColumn("_w", F.lit(True)).join(have, [*by, *names], "full_outer")
    fault = F.when(F.col("_n").isNull(), "missing").when(F.col("_w").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return j.withColumn("fault", fault).filter("fault is not null").select(*by, *names, "fault")


def month_gaps(rows: DataFrame, by: Sequence[str], month: str) -> DataFrame:
    """(by, month, previous, gap): months that don't follow the one before by exactly one; repeated months have gap 0."""
    from ..functions.months import month_index

    w = W.partitionBy(*by).orderBy(month)
    i = month_index(F.col(month))
    return rows.select(*by, month, F.lag(month).over(w).alias("previous"), (i - F.lag(i).over(w)).alias("gap")).filter("gap <> 1")


# Historic series and the successors whose group they take; their own figures are never replaced.
ALIASES = {
    "PPIFGS": "WPSFD49207",
    "PPIFCG": "WPSFD49502",
    "PPIITM": "WPSID61",
    "PPICRM": "WPSID62",
    "CUUR0000SAD": "CUSR0000SAD",
    "CUUR0000SA0L2": "CUSR0000SA0L2",
    "AMBSL": "BOGMBASE",
    "TWEXMMTH": "TWEXAFEGSMTHx",
    "VXOCLSx": "VIXCLSx",
}


def group_of_series(series: DataFrame, groups: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """(series, reference, grp, alias): the group of each series by its upper-cased name, or by that of its successor; NULL if unknown."""
    successor = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.lit(None).cast("map<string,string>")
    one = series.withColumn("_new", F.element_at(successor, F.col("series"))).withColumn("reference", F.coalesce("_new", "series"))
    known = groups.groupBy(F.upper("series").alias("_k")).agg(F.min("grp").cast("int").alias("grp"))
    return one.join(known, F.upper("reference") == F.col("_k"), "left").select("series", "reference", "grp", F.col("_new").isNotNull().alias("alias"))


def overlay_all(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows of the greatest `order` of every key: any number of updates laid over each other in one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_x")).select(*keys, "_x.*")


def first_session_faults(prices: DataFrame, firsts: DataFrame) -> DataFrame:
    """(ticker, month, fault) for prices (session, ticker, adj_close, final) and the first sessions of months: what keeps a month's return from being made."""
    span = prices.groupBy("ticker").agg(F.min("session").alias("a"), F.max("session").alias("b"))
    months = firsts.groupBy().agg(F.array_sort(F.collect_list(F.struct("session", "month"))).alias("all"))  # bounded by the calendar
    within = F.filter("all", lambda m: (m["month"] >= F.substring("a", 1, 7)) & (m["session"] <= F.col("b")))
    want = span.join(F.broadcast(months), how="cross").select("ticker", "a", F.inline(within))
    j = want.join(prices.select("session", "ticker", "adj_close", "final", F.lit(True).alias("_is")), ["session", "ticker"], "left")
    good = (F.col("adj_close") > 0) & (F.abs("adj_close") < float("inf"))
    fault = (
        F.when(F.col("_is").isNull(), F.when(F.col("session") < F.col("a"), "partial_listing_month").otherwise("first_session_missing"))
        .when(~F.coalesce("final", F.lit(False)), "not_final").when(~F.coalesce(good, F.lit(False)), "bad_price")
    )
    return j.select("ticker", "month", fault.alias("fault")).filter("fault is not null")
