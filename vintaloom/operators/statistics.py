"""Block bootstrap, paired tests and multiplicity."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def block_indices(spark: SparkSession, months: int, block: int, draws: int, seed: int = 0) -> DataFrame:
    """(draw, position, idx): circular blocks of consecutive months, cut to `months` positions.

    Starts are a hash of seed, draw and block number, so any part of the table can be made anywhere, alike on every run.
    """
    blocks = -(-months // block)
    starts = spark.range(draws).withColumnRenamed("id", "draw").select("draw", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "draw", "b")), 1, 8), 16, 10).cast("long"), F.lit(months))
    cells = starts.withColumn("s", start).select("draw", (F.col("b") * block).alias("p0"), "s", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"))
    return cells.select("draw", (F.col("p0") + F.col("k")).alias("position"), F.pmod(F.col("s") + F.col("k"), F.lit(months)).alias("idx")).filter(F.col("position") < months)


def resampled_metrics(draws: DataFrame, returns: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, draw, sharpe, sortino, maxdd, positive_ratio) of each resampled series; returns hold (by, idx, x)."""
    by = list(by)
    j = draws.join(returns, "idx")
    run = W.partitionBy(*by, "draw").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    j = j.withColumn("w", F.product(1 + F.col("x")).over(run)).withColumn("dd", F.col("w") / F.greatest(F.lit(1.0), F.max("w").over(run)) - 1)
    sd = F.when(F.max("x") == F.min("x"), 0.0).otherwise(F.stddev_samp("x"))
    down = F.sqrt(F.avg(F.pow(F.least("x", F.lit(0.0)), 2)))
    ratio = lambda a, b: F.when(b != 0, F.try_divide(a, b) * math.sqrt(12))
    return j.groupBy(*by, "draw").agg(ratio(F.avg("x"), sd).alias("sharpe"), ratio(F.avg("x"), down).alias("sortino"), F.min("dd").alias("maxdd"), F.avg((F.col("x") > 0).cast("double")).alias("positive_ratio"))


def interval(draws: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, low, high, valid, excluded): the central 95 % of the draws (linear interpolation); NULL draws are excluded."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*by).agg(q.getItem(0).alias("low"), q.getItem(1).alias("high"), F.count(value).alias("valid"), F.count_if(F.col(value).isNull()).alias("excluded"))


def paired_statistics(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group of (a, b): n, t statistic of a - b, and the Nemenyi statistic z of two methods by mean ranks; NULL with reason if undefined."""
    d = pairs.withColumn("d", F.col("a") - F.col("b")).withColumn("rank_a", F.when(F.col("a") > F.col("b"), 1.0).when(F.col("a") < F.col("b"), 2.0).otherwise(1.5))
    g = d.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.max("d").alias("hi"), F.min("d").alias("lo"), F.avg("rank_a").alias("mean_rank_a"))
    bad = (F.col("n") < 2) | (F.col("hi") == F.col("lo"))
    t = F.when(~bad, F.try_divide(F.col("m"), F.col("s") / F.sqrt("n")))
    z = F.abs(3 - 2 * F.col("mean_rank_a")) / F.sqrt(1 / F.col("n"))
    return g.select(*by, "n", t.alias("t"), "mean_rank_a", z.alias("z"), F.when(F.col("n") < 2, "fewer_than_two").when(bad, "constant_difference").alias("reason"))


def normal_tail(z: Column) -> Column:
    """Two-sided normal p-value erfc(|z| / sqrt 2)."""
    return F.pandas_udf(lambda s: s.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore").astype(float), "double")(z)


def student_tail(t: Column, df: Column) -> Column:
    """One-sided upper tail of Student's t, by the regularised incomplete beta function."""

    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        tiny = 1e-300
        c, d = 1.0, 1 / max(tiny, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
        f = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / (d or tiny), c or tiny
                f *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return front * f / a

    def tail(tv: pd.Series, n: pd.Series) -> pd.Series:
        out = [None if pd.isna(a) or pd.isna(k) or k <= 0 else (0.5 * beta(k / 2, 0.5, k / (k + a * a)) if a > 0 else 1 - 0.5 * beta(k / 2, 0.5, k / (k + a * a))) for a, k in zip(tv, n)]
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(tail, "double")(t.cast("double"), df.cast("double"))


def holm(df: DataFrame, family: Sequence[str], p: str, order: str) -> DataFrame:
    """Add p_holm: sorted p times (n - i), running maximum, at most 1; a NULL counts as 1 and stays NULL. Ties by `order`."""
    q = F.coalesce(F.col(p), F.lit(1.0))
    w = W.partitionBy(*family).orderBy(q, order)
    n = F.count("*").over(W.partitionBy(*family))
    step = df.withColumn("_s", q * (n - F.row_number().over(w) + 1)).withColumn("_m", F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return step.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("_m")))).drop("_s", "_m")


METRICS = ("sharpe", "sortino", "maxdd", "positive_ratio")


def _long(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    return metrics.unpivot(list(by), list(METRICS), "metric", "value")


def compare_pairs(series: DataFrame, months: int, blocks: Sequence[int] = (12, 6, 24), draws: int = 1000, seed: int = 0) -> DataFrame:
    """(pair, metric, block, low, high, valid, excluded): interval of treatment metric less the mean of the controls' defined metrics, under the same block draws for all.

    series: (pair, side 'treatment' or 'control', seed, idx 0..months-1, x); a pair has one treatment and one control a seed.
    """
    spark = series.sparkSession
    drawn = None
    for b in blocks:
        one = block_indices(spark, months, b, draws, seed).select(F.struct(F.lit(b).alias("block"), "draw").alias("draw"), "position", "idx")
        drawn = one if drawn is None else drawn.unionByName(one)
    by = ["pair", "side", "seed"]
    m = _long(resampled_metrics(drawn, series, by), [*by, "draw"])
    treated, control = F.col("side") == "treatment", F.col("side") == "control"
    d = m.groupBy("pair", "metric", "draw").agg((F.max(F.when(treated, F.col("value"))) - F.avg(F.when(control, F.col("value")))).alias("difference"))
    return interval(d.select("pair", "metric", "draw.block", "difference"), ["pair", "metric", "block"], "difference")


def original_metrics(series: DataFrame, months: int) -> DataFrame:
    """(pair, metric, treatment, control_mean, defined, excluded): metrics of the series as they are, the mean over controls whose metric is defined."""
    order = series.sparkSession.range(months).select(F.lit(0).alias("draw"), F.col("id").alias("position"), F.col("id").alias("idx"))
    by = ["pair", "side", "seed"]
    m = _long(resampled_metrics(order, series, by), by)
    control = F.col("side") == "control"
    return m.groupBy("pair", "metric").agg(
        F.max(F.when(~control, F.col("value"))).alias("treatment"), F.avg(F.when(control, F.col("value"))).alias("control_mean"),
        F.count(F.when(control, F.col("value"))).alias("defined"), F.count_if(control & F.col("value").isNull()).alias("excluded"),
    )


def paired_by_draws(series: DataFrame, months: int, block: int = 12, seed: int = 1) -> DataFrame:
    """(pair, metric, n, t, mean_rank_a, z, reason): paired tests over auxiliary draws, draw i of the treatment against control seed i (or the only control)."""
    seeds = series.filter("side = 'control'").groupBy("pair").agg(F.count_distinct("seed").alias("seeds"))
    most = seeds.agg(F.max("seeds")).first()[0] or 0
    drawn = block_indices(series.sparkSession, months, block, most, seed)
    by = ["pair", "side", "seed"]
    m = _long(resampled_metrics(drawn, series, by), [*by, "draw"]).join(seeds, "pair")
    fits = (F.col("side") == "treatment") | (F.col("seeds") == 1) | (F.col("seed") == F.col("draw"))
    p = m.filter(fits).groupBy("pair", "metric", "draw").agg(F.max(F.when(F.col("side") == "treatment", F.col("value"))).alias("a"), F.max(F.when(F.col("side") == "control", F.col("value"))).alias("b"))
    return paired_statistics(p.filter("a is not null and b is not null"), ["pair", "metric"])


def with_pvalues(tests: DataFrame, family: Sequence[str] = ()) -> DataFrame:
    """Add p_t (one-sided), p_nemenyi (two-sided) and both adjusted by Holm within the family."""
    p = tests.withColumns({"p_t": student_tail(F.col("t"), F.col("n") - 1), "p_nemenyi": normal_tail(F.col("z")), "_o": F.concat_ws("|", *[c for c in ("pair", "metric", "ticker") if c in tests.columns]), "_f": F.lit(0)})
    fam = list(family) or ["_f"]
    p = holm(p, fam, "p_t", "_o").withColumnRenamed("p_holm", "holm_t")
    return holm(p, fam, "p_nemenyi", "_o").withColumnRenamed("p_holm", "holm_nemenyi").drop("_o", "_f")


def common_difference(base: DataFrame, variant: DataFrame, by: Sequence[str], month: str, net: str) -> tuple[DataFrame, DataFrame]:
    """Both ledgers cut to the months they share (by group), for a comparison of their metrics."""
    keys = [*by, month]
    both = base.select(*keys).intersect(variant.select(*keys))
    return base.join(both, keys, "left_semi"), variant.join(both, keys, "left_semi")
