"""Implausible readings per source, judged against that source's normal behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut

SKETCH_K = 4096
FENCE = 5.25  # fences at Q1 - FENCE * IQR and Q3 + FENCE * IQR of signed session changes: about 11 typical changes
VOLUME_TIMES = 20.0
RUN = 6
PRIOR = 512  # a context counts as much as its ticker from this number of readings on


def latest_readings(prices: DataFrame) -> DataFrame:
    """One row per (session, ticker): that with the latest retrieved_at, ties by the greatest figures."""
    figures = ["open", "high", "low", "close", "adj_close", "volume"]
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in figures]
    return (
        prices.groupBy("session", "ticker").agg(F.max(F.struct("retrieved_at", *clean)).alias("r")).select("session", "ticker", "r.*")
    )


def normal_behaviour(readings: DataFrame, change: str, level: str, context: str, k: int = SKETCH_K, prior: int = PRIOR) -> DataFrame:
    """Per ticker and context: quartiles of `change` (q1, q3) and the median of `level` (usual), from KLL sketches.

    Sketches are built per (ticker, context) in every task and merged across tasks, then over the contexts of a
    ticker; a sketch has at most a few times k numbers whatever the number of readings. A context's figure is
    weighed against the ticker's by its own readings against `prior`, so a thin context falls back to the
    ticker's behaviour and one without readings takes it whole.
    """
    per_context = readings.groupBy("ticker", context).agg(
        F.kll_sketch_agg_double(F.when(F.col(change).isNotNull(), F.col(change)), F.lit(k)).alias("c"),
        F.kll_sketch_agg_double(F.when(F.col(level).isNotNull(), F.col(level)), F.lit(k)).alias("v"),
    )
    merged = per_context.groupBy("ticker").agg(F.kll_merge_agg_double("c", F.lit(k)).alias("tc"), F.kll_merge_agg_double("v", F.lit(k)).alias("tv"))
    q = lambda s, p: F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, F.lit(p)))
    n = lambda s: F.kll_sketch_get_n_double(s)
    both = lambda own, all_, p: (F.coalesce(q(own, p), F.lit(0.0)) * n(own) + q(all_, p) * prior) / (n(own) + prior)
    return per_context.join(merged, "ticker").select("ticker", context, both("c", "tc", 0.25).alias("q1"), both("c", "tc", 0.75).alias("q3"), both("v", "tv", 0.5).alias("usual"))


def implausible_readings(prices: DataFrame) -> DataFrame:
    """Sessions with a reading that cannot be true, with the reasons found.

    Reasons: 'impossible' (non-positive price, negative or infinite volume, high or low on the wrong side),
    'spike' (adj_close leaves the fences and is back within two sessions), 'range' (high or low against
    close outside the fences), 'volume' (far above the usual) and 'stuck' (from the second of at least RUN
    equal sessions). NULL and NaN readings are no case; a NULL ends a run. A move that holds is no case.
    Fences are those of the ticker on the session's weekday (sessions have no hour), see normal_behaviour; a
    session that is no date has a context of its own. A ticker's window is bounded by its sessions.
    """
    r = latest_readings(prices)
    f = F.col
    inf = F.lit(float("inf"))
    top, low = F.greatest("open", "low", "close"), F.least("open", "high", "close")
    impossible = (
        (f("adj_close") <= 0) | (f("high") <= 0) | (f("low") <= 0) | (f("volume") < 0) | (f("volume") == inf)
        | (f("high") < top) | (f("low") > low)
    )
    w = W.partitionBy("ticker").orderBy("session")
    r = r.withColumns({"bad": F.coalesce(impossible, F.lit(False)), "x": F.when((f("adj_close") > 0) & (f("adj_close") < inf), F.ln("adj_close"))})
    at = lambda k: F.expr(f"{'lag' if k < 0 else 'lead'}(x, {abs(k)}) ignore nulls over (partition by ticker order by session)")
    r = r.withColumns({"p1": at(-1), "p2": at(-2), "n1": at(1), "n2": at(2)})
    r = r.withColumns({"change": f("x") - f("p1"), "vol": F.when((f("volume") > 0) & (f("volume") < inf), f("volume"))})
    for c, ok in (("adj_close", F.lit(True)), ("volume", f("volume") > 0)):
        same = F.coalesce((f(c) == F.lag(c).over(w)) & ok, F.lit(False))
        r = r.withColumn(f"_new_{c}", (~same).cast("int")).withColumn(f"_run_{c}", F.sum(f"_new_{c}").over(w))
        r = r.withColumn(f"_len_{c}", F.count("*").over(W.partitionBy("ticker", f"_run_{c}")))
        r = r.withColumn(f"stuck_{c}", (f(f"_new_{c}") == 0) & (f(f"_len_{c}") >= RUN))
    r = r.withColumn("context", F.coalesce(F.dayofweek(F.try_to_date("session")), F.lit(0)))
    r = cut(r.select("session", "ticker", "context", "high", "low", "close", "volume", "bad", "x", "p1", "p2", "n1", "n2", "change", "vol", "stuck_adj_close", "stuck_volume"))
    j = r.join(normal_behaviour(r, "change", "vol", "context"), ["ticker", "context"], "left")
    spread = FENCE * (f("q3") - f("q1"))
    out = lambda a, b: ((f(a) - f(b)) > f("q3") + spread) | ((f(a) - f(b)) < f("q1") - spread)
    near = lambda a, b: ~out(a, b) & (F.abs(f(a) - f(b)) < 0.5 * F.greatest(F.abs(f("x") - f(a)), F.abs(f("x") - f(b))))
    one = out("x", "p1") & out("x", "n1") & near("n1", "p1")
    first_of_two = out("x", "p1") & out("x", "n2") & out("n1", "p1") & near("n2", "p1")
    second_of_two = out("x", "p2") & out("x", "n1") & out("p1", "p2") & near("n1", "p2")
    wide = f("q3") + spread
    ratio = lambda a, b: F.when((f(a) > 0) & (f(b) > 0), F.abs(F.ln(f(a) / f(b))))
    reasons = F.array_compact(F.array(
        F.when(f("bad"), "impossible"),
        F.when(F.coalesce(one, F.lit(False)) | F.coalesce(first_of_two, F.lit(False)) | F.coalesce(second_of_two, F.lit(False)), "spike"),
        F.when((ratio("high", "close") > wide) | (ratio("low", "close") > wide), "range"),
        F.when(f("volume") > VOLUME_TIMES * f("usual"), "volume"),
        F.when(f("stuck_adj_close") | f("stuck_volume"), "stuck"),
    ))
    return j.select("session", "ticker", reasons.alias("reasons")).filter(F.size("reasons") > 0)
