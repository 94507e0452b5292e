"""Scores, allocations, accounts and performance of monthly strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.months import add_month, month_index
from ..functions.vectors import let


def conditional_sharpe(returns: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and their ratio; a group of fewer than two or of equal returns has score 0, status 'undefined'."""
    g = returns.groupBy(*by).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.max("r").alias("hi"), F.min("r").alias("lo"))
    flat = (F.col("n") < 2) | (F.col("hi") == F.col("lo"))
    return g.select(*by, "n", "mean", F.when(F.col("n") >= 2, F.when(F.col("hi") == F.col("lo"), 0.0).otherwise(F.col("sd"))).alias("sd"), F.when(flat, 0.0).otherwise(F.try_divide("mean", "sd")).alias("score"), F.when(flat, "undefined").otherwise("ok").alias("status"))


def covariance(returns: DataFrame, shrink: float = 0.0, eps: float = 0.0) -> DataFrame:
    """(a, b, cov): sample covariance of tickers over common months, shrunk toward its diagonal: (1-s) S + s diag(S) + eps I.

    Pairs come from a join on the month, so the work is months x tickers squared.
    """
    a, b = returns.select("month", F.col("ticker").alias("a"), F.col("r").alias("ra")), returns.select("month", F.col("ticker").alias("b"), F.col("r").alias("rb"))
    s = a.join(b, "month").groupBy("a", "b").agg(F.covar_samp("ra", "rb").alias("s"))
    return s.select("a", "b", F.when(F.col("a") == F.col("b"), F.col("s") + eps).otherwise((1 - shrink) * F.col("s")).alias("cov"))


def trailing_scores(returns: DataFrame, back: int = 12, gap: int = 2) -> DataFrame:
    """(month, ticker, score): mean over deviation of the `back` months' returns that end `gap` months before; none unless all are there."""
    w = W.partitionBy("ticker").orderBy(month_index(F.col("month"))).rangeBetween(-gap - back + 1, -gap)
    return returns.select("month", "ticker", F.when(F.count("r").over(w) == back, F.try_divide(F.avg("r").over(w), F.stddev_samp("r").over(w))).alias("score")).filter("score is not null")


def allocate(scores: DataFrame, size: int, sizing: str, by: Sequence[str] = ("month",)) -> DataFrame:
    """(by, ticker, weight): chosen scores over the sum of their sizes; no choice leaves all in cash.

    lo: the greatest positive scores; lns: up to `size` on each side; los: the greatest by size. Ties by ticker.
    """
    by = list(by)
    s = scores.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") != 0))
    rank = lambda key, keep: F.when(keep, F.row_number().over(W.partitionBy(*by, keep).orderBy(key, "ticker")))
    up = rank(F.desc("score"), F.col("score") > 0) <= size
    down = rank(F.asc("score"), F.col("score") < 0) <= size
    wide = F.row_number().over(W.partitionBy(*by).orderBy(F.abs("score").desc(), "ticker")) <= size
    chosen = {"lo": up, "lns": F.coalesce(up, F.lit(False)) | F.coalesce(down, F.lit(False)), "los": wide}[sizing]
    s = s.withColumn("_in", F.coalesce(chosen, F.lit(False))).filter("_in")
    return s.select(*by, "ticker", (F.col("score") / F.sum(F.abs("score")).over(W.partitionBy(*by))).alias("weight"))


def allocate_mixed(scores: DataFrame, modal: DataFrame, size: int) -> DataFrame:
    """los in months whose modal label is 0, lo otherwise; modal has one (month, label) a month."""
    both = allocate(scores, size, "lo").withColumn("kind", F.lit("lo")).unionByName(allocate(scores, size, "los").withColumn("kind", F.lit("los")))
    want = modal.select("month", F.when(F.col("label") == 0, "los").otherwise("lo").alias("kind"))
    return both.join(want, ["month", "kind"]).select("month", "ticker", "weight")


SIZINGS, SIZES = ("lo", "lns", "los", "mx"), (2, 3, 4)


def strategy_ids(models: Sequence[str], sizings: Sequence[str] = SIZINGS, sizes: Sequence[int] = SIZES) -> list[str]:
    return [f"{m}_{z}_{n}" for m in models for z in sizings for n in sizes]


def grid_weights(scores: DataFrame, modal: DataFrame, by: Sequence[str] = ("month", "model"), month: str = "month", sizings: Sequence[str] = SIZINGS, sizes: Sequence[int] = SIZES) -> DataFrame:
    """(by, sizing, size, ticker, weight): every model's scores under every sizing and size, from one ranking.

    mx is los in months whose modal label is 0 (modal: month, label) and lo otherwise. Scores that are NULL,
    0 or not finite are never chosen; ties by ticker. A group without a choice has no row: all cash.
    """
    by = list(by)
    x = F.col("score")
    s = scores.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x != 0)).select(*by, "ticker", "score")
    s = s.join(modal.select(F.col("month").alias(month), (F.col("label") == 0).alias("_crisis")).distinct(), month, "left")
    g = W.partitionBy(*by)
    s = s.withColumns({
        "_up": F.when(x > 0, F.row_number().over(W.partitionBy(*by, x > 0).orderBy(x.desc(), "ticker"))),
        "_down": F.when(x < 0, F.row_number().over(W.partitionBy(*by, x > 0).orderBy(x, "ticker"))),
        "_wide": F.row_number().over(g.orderBy(F.abs(x).desc(), "ticker")),
    })
    s = s.filter((F.col("_wide") <= max(sizes)) | (F.col("_up") <= max(sizes)) | (F.col("_down") <= max(sizes)))
    s = s.withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes])))
    up, down, wide = (F.coalesce(F.col(c) <= F.col("size"), F.lit(False)) for c in ("_up", "_down", "_wide"))
    chosen = {"lo": up, "lns": up | down, "los": wide, "mx": F.when(F.coalesce("_crisis", F.lit(False)), wide).otherwise(up)}
    s = s.withColumn("sizing", F.explode(F.array_compact(F.array(*[F.when(chosen[z], z) for z in sizings]))))
    return s.select(*by, "sizing", "size", "ticker", (x / F.sum(F.abs(x)).over(W.partitionBy(*by, "sizing", "size"))).alias("weight"))


def benchmark_weights(panel: DataFrame, single: str) -> DataFrame:
    """(strategy, month, ticker, weight): all in one asset, and equal shares."""
    p = panel.select("month", "ticker").distinct()
    equal = p.withColumn("weight", 1 / F.count("*").over(W.partitionBy("month"))).withColumn("strategy", F.lit("ew"))
    return equal.unionByName(p.withColumn("weight", (F.col("ticker") == single).cast("double")).withColumn("strategy", F.lit("single"))).select("strategy", "month", "ticker", "weight")


def volatility_scale(weights: DataFrame, returns: DataFrame, lookback: int = 36, target: float = 0.1, cap: float = 2.0, train: int = 48, by: Sequence[str] = ()) -> DataFrame:
    """(by, month, volatility, gross, multiplier, status): scale to the target, within the gross cap; 0 where volatility or gross is 0.

    Volatility is sqrt(12 var) of the month's weights applied to the last `lookback` of the `train` returns that
    end two months before, all known at the decision. A month with fewer than train complete months keeps its
    row, with status 'insufficient_history' and no multiplier; a panel with a missing ticker isn't complete.
    """
    by = list(by)
    w = weights.select(*by, F.col("month").alias("at"), "ticker", "weight")
    key = [*by, "at"]
    past = w.select("at").distinct().select("at", F.explode(F.sequence(F.lit(-train - 1), F.lit(-2))).alias("o")).withColumn("month", add_month(F.col("at"), F.col("o")))
    held = w.groupBy(*key).agg(F.count("*").alias("_held"), F.sum(F.abs("weight")).alias("gross"))
    series = past.join(returns, "month").join(w, ["at", "ticker"]).groupBy(*key, "o").agg(F.sum(F.col("weight") * F.col("r")).alias("x"), F.count("r").alias("_n"))
    full = series.join(held.select(*key, "_held"), key).filter("_n = _held")
    vol = full.groupBy(*key).agg(F.count("*").alias("n"), F.sqrt(12 * F.var_samp(F.when(F.col("o") >= -lookback - 1, F.col("x")))).alias("volatility"))
    enough = F.coalesce(F.col("n") == train, F.lit(False))
    m = F.when((F.col("volatility") == 0) | (F.col("gross") == 0), 0.0).otherwise(F.least(F.try_divide(F.lit(target), F.col("volatility")), F.try_divide(F.lit(cap), F.col("gross"))))
    return held.join(vol, key, "left").select(
        *by, F.col("at").alias("month"), F.when(enough, F.col("volatility")).alias("volatility"), "gross", F.when(enough, m).alias("multiplier"), F.when(enough, "ok").otherwise("insufficient_history").alias("status")
    )


def account(
    weights: DataFrame, returns: DataFrame, by: Sequence[str], cost_bps: float = 0.0, borrow: float = 0.0, financing: float = 0.0, cash_rate: float = 0.0,
    days: int | DataFrame = 30, gross_cap: float | None = None, gaps: bool = False,
) -> DataFrame:
    """Self-financing ledger per strategy: one row a month with costs, net return, wealth and drawdown.

    Each month pays cost_bps on turnover against the drifted weights of the month before (first: all cash),
    borrowing on shorts and financing of negative cash for its days of a 365-day year; positive cash earns
    cash_rate. `days` is a number or a table (month, days). A ticker that isn't listed has weight 0; every
    ticker held needs a return. Errors: a held ticker without a return, exposure above gross_cap, a month that
    doesn't follow the one before (unless `gaps`), and a wealth of 0 or less (bankruptcy). The recursion runs as
    a fold over the strategy's months, which the calendar bounds, in the JVM.
    """
    by = list(by)
    held = weights.join(returns, ["month", "ticker"], "left").groupBy(*by, "month").agg(
        F.map_from_entries(F.collect_list(F.struct("ticker", F.coalesce("weight", F.lit(0.0))))).alias("w"), F.map_from_entries(F.collect_list(F.struct("ticker", "r"))).alias("r")
    )
    held = held.withColumn("days", F.lit(days).cast("double")) if isinstance(days, int) else held.join(days.select("month", F.col("days").cast("double")), "month", "left")
    s = held.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("month", month_index(F.col("month")).alias("i"), "days", F.map_entries("w").alias("w"), F.map_entries("r").alias("r")))).alias("months"))
    plus = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q)
    stop = lambda bad, text, month, value: F.when(bad, F.raise_error(F.concat(F.lit(text), month))).otherwise(value)
    names = ("turnover", "gross", "transaction_cost", "borrow_cost", "financing_cost", "cash_return", "cost", "net", "gross_exposure", "net_exposure")
    row = "struct<month:string,days:double," + ",".join(f"{n}:double" for n in names) + ",wealth:double,drawdown:double>"
    start = F.struct(F.create_map().cast("map<string,double>").alias("pre"), F.lit(1.0).alias("wealth"), F.lit(1.0).alias("peak"), F.lit(None).cast("int").alias("i"), F.array().cast(f"array<{row}>").alias("rows"))

    def figures(state: Column, m: Column, w: Column, r: Column) -> Column:
        """One month's figures before wealth."""
        at = lambda name: F.get(F.filter(r, lambda e: e["key"] == name), F.lit(0))["value"]
        cash, year = 1 - plus(F.transform(w, lambda e: e["value"])), m["days"] / 365
        turnover = plus(F.map_values(F.map_zip_with(F.map_from_entries(w), state["pre"], lambda _, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))))))
        gross = plus(F.transform(w, lambda e: F.when(e["value"] == 0, 0.0).otherwise(stop(at(e["key"]).isNull(), "no return of a held ticker in ", m["month"], e["value"] * at(e["key"])))))
        exposure = plus(F.transform(w, lambda e: F.abs(e["value"])))
        return F.struct(
            turnover.alias("turnover"), gross.alias("gross"), (turnover * (cost_bps / 1e4)).alias("transaction_cost"),
            (plus(F.transform(w, lambda e: F.greatest(-e["value"], F.lit(0.0)))) * borrow * year).alias("borrow_cost"), (F.greatest(-cash, F.lit(0.0)) * financing * year).alias("financing_cost"),
            (F.greatest(cash, F.lit(0.0)) * cash_rate * year).alias("cash_return"), (stop(exposure > gross_cap + 1e-12, "exposure above the cap in ", m["month"], exposure) if gross_cap is not None else exposure).alias("gross_exposure"), (1 - cash).alias("net_exposure"),
        )

    def step(state: Column, m: Column) -> Column:
        def wealthy(f: Column) -> Column:
            cost = f["transaction_cost"] + f["borrow_cost"] + f["financing_cost"]
            net = f["gross"] + f["cash_return"] - cost
            return let(F.struct(f.alias("f"), cost.alias("cost"), net.alias("net"), (state["wealth"] * (1 + net)).alias("wealth")), lambda o: closed(state, m, o))

        return let(figures(state, m, m["w"], m["r"]), wealthy)

    def closed(state: Column, m: Column, o: Column) -> Column:
        wealth = stop(o["wealth"] <= 0, "bankruptcy in ", m["month"], o["wealth"])
        if not gaps:
            wealth = stop(F.coalesce(m["i"] != state["i"] + 1, F.lit(False)), "a month is missing before ", m["month"], wealth)
        peak = F.greatest(state["peak"], o["wealth"])
        f = o["f"]
        drift = F.transform(m["w"], lambda e: F.struct(e["key"].alias("key"), (e["value"] * (1 + F.coalesce(F.get(F.filter(m["r"], lambda q: q["key"] == e["key"]), F.lit(0))["value"], F.lit(0.0))) / (1 + o["net"])).alias("value")))
        line = F.struct(m["month"].alias("month"), m["days"].alias("days"), *[(o[n] if n in ("cost", "net") else f[n]).alias(n) for n in names], wealth.alias("wealth"), (o["wealth"] / peak - 1).alias("drawdown"))
        return F.struct(F.map_from_entries(drift).alias("pre"), o["wealth"].alias("wealth"), peak.alias("peak"), m["i"].alias("i"), F.concat(state["rows"], F.array(line)).cast(f"array<{row}>").alias("rows"))

    return s.select(*by, F.inline(F.aggregate("months", start, step, lambda z: z["rows"])))


def account_without_costs(weights: DataFrame, returns: DataFrame, by: Sequence[str]) -> DataFrame:
    """The ledger at zero cost, where turnover needs only the month before: plain aggregations, no fold.

    A ticker that isn't listed has weight 0; what was held in the strategy's month before and isn't any more counts as turnover.
    """
    by = list(by)
    j = weights.join(returns, ["month", "ticker"])
    j = j.withColumn("gross", F.sum(F.col("weight") * F.col("r")).over(W.partitionBy(*by, "month"))).withColumn("end", F.col("weight") * (1 + F.col("r")) / (1 + F.col("gross")))
    m = j.groupBy(*by, "month").agg(F.first("gross").alias("net"), F.sum(F.abs("weight")).alias("gross_exposure"), F.sum("weight").alias("net_exposure"))
    after = m.select(*by, "month", F.lead("month").over(W.partitionBy(*by).orderBy("month")).alias("_next"))
    now = j.select(*by, "month", "ticker", "weight", F.lit(0.0).alias("pre"))
    left = j.select(*by, "month", "ticker", "end").join(after.filter("_next is not null"), [*by, "month"]).select(*by, F.col("_next").alias("month"), "ticker", F.lit(0.0).alias("weight"), F.col("end").alias("pre"))
    moved = now.unionByName(left).groupBy(*by, "month", "ticker").agg((F.sum("weight") - F.sum("pre")).alias("d")).groupBy(*by, "month").agg(F.sum(F.abs("d")).alias("turnover"))
    return wealth(m.join(moved, [*by, "month"]), by, "month", "net")


def wealth(returns: DataFrame, by: Sequence[str], month: str, net: str) -> DataFrame:
    """Add wealth, the running product of 1 + net from 1, and drawdown against the running peak (at least 1)."""
    w = W.partitionBy(*by).orderBy(month).rowsBetween(W.unboundedPreceding, 0)
    x = returns.withColumn("wealth", F.product(1 + F.col(net)).over(w))
    return x.withColumn("drawdown", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(w)) - 1)


def performance(ledger: DataFrame, by: Sequence[str], month: str, net: str, turnover: str | None = None, cost: Column | None = None, rf: float = 0.0) -> DataFrame:
    """Performance of each strategy over its months, with the reason where a ratio is NULL.

    cagr = wealth^(12/n) - 1; ann_vol and sharpe use the sample deviation, sortino the root mean square of
    negative excess over all months; a constant series has deviation exactly 0.
    """
    x = wealth(ledger, by, month, net).withColumn("_e", F.col(net) - rf)
    n, f = F.count(net), F.col
    a = x.groupBy(*by).agg(
        n.alias("n_months"), F.min(month).alias("start_month"), F.max(month).alias("end_month"), F.max_by("wealth", month).alias("_w"),
        F.when(F.max(net) == F.min(net), 0.0).otherwise(F.stddev_samp(net)).alias("_sd"), F.avg("_e").alias("_me"), F.sqrt(F.avg(F.pow(F.least("_e", F.lit(0.0)), 2))).alias("_down"),
        F.min("drawdown").alias("maxdd"), F.coalesce(F.avg(F.when(f("drawdown") < 0, f("drawdown"))), F.lit(0.0)).alias("avgdd"), F.avg("drawdown").alias("avgdd_all_months"),
        F.avg((f(net) > 0).cast("double")).alias("positive_ratio"), *([F.avg(turnover).alias("mean_turnover")] if turnover else []), *([F.sum(cost).alias("total_cost")] if cost is not None else []),
    )
    few = f("n_months") < 2
    return a.select(
        *by, "n_months", "start_month", "end_month", F.expm1(F.ln("_w") * 12 / f("n_months")).alias("cagr"), F.when(~few, f("_sd") * F.sqrt(F.lit(12.0))).alias("ann_vol"),
        F.when(~few & (f("_sd") != 0), f("_me") / F.when(f("_sd") == 0, 1.0).otherwise(f("_sd")) * F.sqrt(F.lit(12.0))).alias("sharpe"),
        F.when(~few & (f("_down") != 0), f("_me") / F.when(f("_down") == 0, 1.0).otherwise(f("_down")) * F.sqrt(F.lit(12.0))).alias("sortino"),
        "maxdd", "avgdd", "avgdd_all_months", "positive_ratio", *(["mean_turnover"] if turnover else []), *(["total_cost"] if cost is not None else []),
        F.when(few, "fewer_than_two_months").when(f("_sd") == 0, "zero_excess_return_standard_deviation").alias("sharpe_reason"), F.when(few, "fewer_than_two_months").when(f("_down") == 0, "zero_downside_rms").alias("sortino_reason"),
    )


def verify_ledger(ledger: DataFrame, by: Sequence[str], month: str, rtol: float = 1e-8, atol: float = 1e-10) -> DataFrame:
    """Recompute net return, wealth and drawdown of a stored ledger; per strategy, the rows where each differs."""
    f = F.col
    x = wealth(ledger.withColumnsRenamed({"wealth": "s_wealth", "drawdown": "s_drawdown"}), by, month, "net_return")
    net = f("gross_return") + f("cash_return") - f("transaction_cost") - f("borrow_cost") - f("financing_cost")
    off = lambda a, b: F.count_if(F.coalesce(F.abs(a - b) > atol + rtol * F.abs(b), F.lit(True)))
    return x.groupBy(*by).agg(F.count("*").alias("n_rows"), off(net, f("net_return")).alias("net_off"), off(f("wealth"), f("s_wealth")).alias("wealth_off"), off(f("drawdown"), f("s_drawdown")).alias("drawdown_off"))


def verify_weights(scores: DataFrame, modal: DataFrame, stored: DataFrame, by: Sequence[str] = ("month", "model"), month: str = "month", sizes: Sequence[int] = SIZES, rtol: float = 1e-8, atol: float = 1e-10) -> DataFrame:
    """(by, sizing, size, missing, unexpected, off): stored weights against weights derived anew from the scores.

    Derived by another way than grid_weights: scores of a group sorted in one array and cut, no ranking. A
    group's array is bounded by its tickers.
    """
    by = list(by)
    x = F.col("score")
    good = scores.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x != 0))
    entry = lambda key: F.array_sort(F.collect_list(F.struct(key.alias("k"), "ticker", "score")))
    g = good.groupBy(*by).agg(entry(-x).alias("hi"), entry(x).alias("low"), entry(-F.abs(x)).alias("far"))
    g = g.join(modal.select(F.col("month").alias(month), "label").distinct(), month, "left")
    g = g.withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes])))
    top = lambda a, sign: F.slice(F.filter(a, lambda e: e["score"] * sign > 0), F.lit(1), F.col("size"))
    lo, los = top(F.col("hi"), 1), F.slice("far", F.lit(1), F.col("size"))
    rules = {"lo": lo, "lns": F.concat(lo, top(F.col("low"), -1)), "los": los, "mx": F.when(F.col("label") == 0, los).otherwise(lo)}
    parts = F.array(*[F.struct(F.lit(z).alias("sizing"), a.alias("chosen")) for z, a in rules.items()])
    d = g.select(*by, "size", F.explode(parts).alias("p")).withColumn("mass", F.aggregate("p.chosen", F.lit(0.0), lambda s, e: s + F.abs(e["score"])))
    d = d.select(*by, F.col("p.sizing").alias("sizing"), "size", "mass", F.explode("p.chosen").alias("e")).select(*by, "sizing", "size", F.col("e.ticker").alias("ticker"), (F.col("e.score") / F.col("mass")).alias("want"))
    j = d.join(stored.select(*by, "sizing", "size", "ticker", "weight"), [*by, "sizing", "size", "ticker"], "full_outer")
    off = F.abs(F.col("want") - F.col("weight")) > atol + rtol * F.abs(F.col("want"))
    return j.groupBy(*by, "sizing", "size").agg(F.count_if(F.col("weight").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unexpected"), F.count_if(off).alias("off"))


def verify_metrics(ledger: DataFrame, stored: DataFrame, by: Sequence[str], month: str, net: str, rtol: float = 1e-8, atol: float = 1e-10) -> DataFrame:
    """(by, metric, stored, found): stored metrics (by, n_months, cagr, ann_vol, sharpe, sortino, maxdd, avgdd) that differ from ones made anew by a fold over the sorted months."""
    by = list(by)
    s = ledger.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(month, net))).getField(net).alias("x"))
    n = F.size("x").cast("double")
    mean = F.aggregate("x", F.lit(0.0), lambda a, b: a + b) / n
    square = lambda f: F.aggregate(F.transform("x", f), F.lit(0.0), lambda a, b: a + b)
    walk = F.aggregate(
        "x", F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("peak"), F.array().cast("array<double>").alias("dd")),
        lambda z, r: let(z["w"] * (1 + r), lambda w: F.struct(w.alias("w"), F.greatest(z["peak"], w).alias("peak"), F.concat(z["dd"], F.array(w / F.greatest(z["peak"], w) - 1)).alias("dd"))),
    )
    s = s.withColumns({"_n": n, "_m": mean}).withColumn("_w", walk)
    sd = F.when(F.array_max("x") == F.array_min("x"), 0.0).otherwise(F.sqrt(square(lambda v: F.pow(v - F.col("_m"), 2)) / F.greatest(F.col("_n") - 1, F.lit(1.0))))
    s = s.withColumns({"_sd": sd, "_down": F.sqrt(square(lambda v: F.pow(F.least(v, F.lit(0.0)), 2)) / F.col("_n")), "_below": F.filter("_w.dd", lambda v: v < 0)})
    many, root = F.col("_n") >= 2, F.sqrt(F.lit(12.0))
    anew = {
        "n_months": F.col("_n"), "cagr": F.pow(F.col("_w.w"), 12 / F.col("_n")) - 1, "ann_vol": F.when(many, F.col("_sd") * root), "sharpe": F.when(many & (F.col("_sd") != 0), F.try_divide(F.col("_m"), F.col("_sd")) * root),
        "sortino": F.when(many & (F.col("_down") != 0), F.try_divide(F.col("_m"), F.col("_down")) * root), "maxdd": F.array_min("_w.dd"),
        "avgdd": F.coalesce(F.try_divide(F.aggregate("_below", F.lit(0.0), lambda a, b: a + b), F.size("_below")), F.lit(0.0)),
    }
    j = s.join(stored.select(*by, *[F.col(c).cast("double").alias(f"s_{c}") for c in anew]), by, "full_outer")
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"s_{c}").alias("stored"), e.alias("found")) for c, e in anew.items()])
    j = j.select(*by, F.explode(rows).alias("m")).select(*by, "m.*")
    same = F.when(F.col("stored").isNull() | F.col("found").isNull(), F.col("stored").isNull() & F.col("found").isNull()).otherwise(F.abs(F.col("stored") - F.col("found")) <= atol + rtol * F.abs("found"))
    return j.filter(~same)
