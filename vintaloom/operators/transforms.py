"""Stationarity transforms, imputation and scaling of month-by-series panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .timing import spine


def finite(x: Column) -> Column:
    """x, or NULL where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def transform_series(panel: DataFrame, entity: Sequence[str], month: str, value: str, tcode: str) -> DataFrame:
    """Add column y, the value under its transformation code, on a calendar without gaps.

    Codes: 1 level, 2 first and 3 second difference, 4 log, 5 first and 6 second difference of the log,
    7 difference of the growth rate. Logs of figures not above zero, divisions by zero and anything not
    finite give NULL; nothing is filled. Any other code gives NULL. Needs one row a month and entity.
    """
    codes = panel.groupBy(*entity).agg(F.max(tcode).alias("_code"))
    full = spine(panel.select(*entity, month, value), entity, month).join(codes, list(entity))
    w = W.partitionBy(*entity).orderBy(month)
    x = finite(F.col(value))
    full = full.withColumn("_x", x).withColumn("_l", log_positive(F.col("_x")))
    lag = lambda c, k: F.lag(c, k).over(w)
    growth = lambda k: F.try_divide(lag("_x", k) if k else F.col("_x"), lag("_x", k + 1)) - 1
    full = full.withColumns({"_x1": lag("_x", 1), "_x2": lag("_x", 2), "_l1": lag("_l", 1), "_l2": lag("_l", 2), "_g": growth(0), "_g1": growth(1)})
    c = F.col
    y = (
        F.when(c("_code") == 1, c("_x")).when(c("_code") == 2, c("_x") - c("_x1")).when(c("_code") == 3, c("_x") - 2 * c("_x1") + c("_x2"))
        .when(c("_code") == 4, c("_l")).when(c("_code") == 5, c("_l") - c("_l1")).when(c("_code") == 6, c("_l") - 2 * c("_l1") + c("_l2")).when(c("_code") == 7, c("_g") - c("_g1"))
    )
    return full.select(*entity, month, value, c("_code").alias(tcode), finite(y).alias("y"))


def impute_bounded(panel: DataFrame, entity: Sequence[str], month: str, value: str, limit: int = 2, fit_from: str | None = None, fit_to: str | None = None) -> DataFrame:
    """Carry values forward over at most `limit` calendar months, then use the median of the fit months' own values.

    Adds imputed and the disjoint masks observed, ffill, median_fill. Fit months are fit_from..fit_to
    (default: all); rows outside them are neither used for the median nor, unless they precede the fit, carried on.
    """
    full = spine(panel.select(*entity, month, value), entity, month)
    fit = F.lit(True)
    if fit_from:
        fit = fit & (F.col(month) >= fit_from)
    if fit_to:
        fit = fit & (F.col(month) <= fit_to)
    full = full.withColumns({"_x": finite(F.col(value)), "_fit": fit})
    w = W.partitionBy(*entity).orderBy(month)
    usable = F.when(F.col("_fit") | (F.col(month) < (fit_from or "0000-00")), F.col("_x"))
    full = full.withColumn("_c", F.last(usable, True).over(w.rowsBetween(-limit, -1)) if limit else F.lit(None).cast("double"))
    med = F.percentile(F.when(F.col("_fit"), F.col("_x")), F.lit(0.5)).over(W.partitionBy(*entity))
    full = full.withColumn("_m", med)
    return full.select(
        *entity, month, value, F.coalesce("_x", "_c", "_m").alias("imputed"), F.col("_x").isNotNull().alias("observed"),
        (F.col("_x").isNull() & F.col("_c").isNotNull()).alias("ffill"), (F.col("_x").isNull() & F.col("_c").isNull() & F.col("_m").isNotNull()).alias("median_fill"),
    )


def selection_reasons(panel: DataFrame, entity: str, value: str, group: str, months: int, missing_rate: float = 0.2, excluded_group: int = 6) -> DataFrame:
    """Per series: missing rate over `months` rows and why it can't be used (empty: it can)."""
    x = finite(F.col(value))
    s = panel.groupBy(entity).agg(F.max(group).alias("grp"), F.count(x).alias("observed"), F.count_distinct(x).alias("different"))
    s = s.withColumn("missing_rate", 1 - F.col("observed") / F.lit(months))
    why = F.array_compact(F.array(
        F.when(F.col("grp") == excluded_group, "excluded_group"), F.when(F.col("observed") == 0, "no_observations"),
        F.when((F.col("observed") > 0) & (F.col("different") == 1), "constant"), F.when(F.col("missing_rate") > missing_rate, "missing_rate"),
    ))
    return s.select(entity, "observed", "missing_rate", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("selected"))


def standardize(panel: DataFrame, entity: Sequence[str], value: str) -> DataFrame:
    """Add z, the value less the entity's mean over its population deviation; NULL where that is zero."""
    w = W.partitionBy(*entity)
    return panel.withColumn("z", F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))
