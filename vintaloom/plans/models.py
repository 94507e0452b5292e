"""Queries of state, portfolio, statistics and numeric operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.months import add_month, month_index
from ..functions.vectors import combine_probabilities, distance_probabilities
from ..operators import numeric as N, portfolio as P, regimes as R, statistics as S, transforms as X
from ..operators import timing as T, windows as D
from ..operators.timing import training_windows
from ..session import cut
from ..sources import views as V
from ..sources.tables import table
from .panels import _HOLIDAYS, IM, MACRO, MI, RET, r8

LAB_OF = lambda k: f"lab as (select month, (({MI('month')} * 7 + {MI('month')} // 5) % {k})::int as label from (select distinct month from ret))"
LAB = LAB_OF(6)
CEN = """e as (select vec_id as id, embedding::double[] as x, label from embeddings), nz as (select id, label, list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda t: t * t)))) as u from e),
  comp as (select label, i, avg(u[i]) as m from nz, (select unnest(generate_series(1, 64)) as i) group by all), cen0 as (select label, list(m order by i) as c from comp group by label),
  cen as (select label, list_transform(c, lambda v: v / sqrt(list_sum(list_transform(c, lambda t: t * t)))) as center from cen0),
  dist as (select nz.id, cen.label, greatest(0, least(2, 1 - list_dot_product(nz.u, cen.center))) as distance from nz, cen)"""
SOFT = CEN + ", soft as (select id, label, (1 - distance / sum(distance) over (partition by id)) / (count(*) over (partition by id) - 1) as p from dist)"
TRANS_OF = lambda k: f"""{RET}, {LAB_OF(k)}, st as (select label as src, lead(label) over (order by month) as dst, lead({MI('month')}) over (order by month) - {MI('month')} as gap from lab),
  cnt as (select src, dst, count(*) as n from st where gap = 1 group by all), occ as (select label as src, count(*) as o from lab group by 1),
  grid as (select a as src, b as dst from (select unnest(generate_series(0, {k - 1})) as a), (select unnest(generate_series(0, {k - 1})) as b)),
  tm as (select src::int as src, dst::int as dst, coalesce(n, 0) as n, coalesce(o, 0) as o, sum(coalesce(n, 0)) over (partition by src) as outn from grid left join cnt using (src, dst) left join occ using (src)),
  mat as (select src, dst, n, case when outn = 0 then (src = dst)::int::double else n / outn end as p, coalesce(n / nullif(o, 0), 0)::double as p_literal, (select count(*) from st where gap <> 1) as skipped from tm)"""  # noqa: E731
TRANS = TRANS_OF(6)
SCORES = RET + f""", tw as (select month, ticker, avg(r) over w as m, stddev_samp(r) over w as s, count(r) over w as c from ret window w as (partition by ticker order by {MI('month')} range between 13 preceding and 2 preceding)),
  sc as (select month, ticker, m / nullif(s, 0) as score from tw where c = 12)"""
LO2 = SCORES + """, rk as (select *, row_number() over (partition by month order by score desc, ticker) as rn from sc where score > 0), lo2 as (select month, ticker, score / sum(score) over (partition by month) as weight from rk where rn <= 2)"""


def _dist(s, d):
    p = V.features(s, d)
    return R.distances(p, R.centroids(p))


def _returns(s, d):
    return V.asset_returns(s, d)


def _matrix(s, d):
    return R.transitions(V.regimes(_returns(s, d)), 6)


def spherical_centroids(s, d):
    c = R.centroids(V.features(s, d))
    return c.select("label", F.posexplode("center").alias("i", "v")).select("label", "i", r8("v"))


def cosine_distances(s, d):
    return _dist(s, d).select("id", "label", r8("distance"))


def nearest_center(s, d):
    return R.nearest(_dist(s, d)).select("id", "label", F.round("distance", 6).alias("distance"))


def soft_memberships(s, d):
    return R.soft_memberships(_dist(s, d)).select("id", "label", r8("p"))


def combined_probabilities(s, d):
    g = _dist(s, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("label", "distance"))).getField("distance").alias("d"))
    p0 = distance_probabilities(F.slice("d", 1, 2)).getItem(0)
    rest = F.slice("d", F.lit(3), F.size("d") - 2)
    return g.select("id", F.posexplode(combine_probabilities(p0, distance_probabilities(rest))).alias("k", "p")).select("id", "k", r8("p"))


def transition_matrix(s, d):
    return _matrix(s, d).select("src", "dst", "n", r8("p"), r8("p_literal"), "skipped")


def conditional_departures(s, d):
    return R.departures(_matrix(s, d)).select("src", "dst", r8("p"), "absorbing")


def next_probabilities(s, d):
    now = R.soft_memberships(_dist(s, d))
    return R.next_probabilities(now, R.transitions(V.regimes(_returns(s, d), 10), 10)).select("id", "label", r8("p"))


def modal_regime(s, d):
    p = R.soft_memberships(_dist(s, d)).withColumn("p", F.round("p", 9))
    return R.modal(p)


def center_order(s, d):
    return R.canonical_order(R.centroids(V.features(s, d)))


def indicator_means(s, d):
    m = V.macro_panel(s, d).join(V.regimes(V.macro_panel(s, d)), "month")
    x = X.finite(F.col("value"))
    return m.groupBy("series", "label").agg(F.round(F.avg(x), 7).alias("mean"), F.count(x).alias("n"))


def indicator_minmax(s, d):
    m = V.macro_panel(s, d).join(V.regimes(V.macro_panel(s, d)), "month").groupBy("series", "label").agg(F.avg("value").alias("mean"))
    return R.row_minmax(m, "series", "mean").select("series", "label", r8("scaled"))


def indicator_extremes(s, d):
    m = V.macro_panel(s, d).join(V.regimes(V.macro_panel(s, d)), "month").groupBy("series", "label").agg(F.avg("value").alias("mean"))
    x = R.row_minmax(m, "series", "mean").withColumn("k", F.round("scaled", 9))
    return x.groupBy("label").agg(F.max(F.struct("k", (-F.col("series")).alias("s"))).alias("h"), F.min(F.struct("k", "series")).alias("l")).select("label", (-F.col("h.s")).alias("highest"), F.col("l.series").alias("lowest"))


def downturn_islands(s, d):
    w = W.orderBy("month")
    m = V.macro_panel(s, d).groupBy("month").agg(F.sum("value").alias("v"))
    flags = m.withColumn("down", F.coalesce(F.col("v") < F.lag("v").over(w), F.lit(False))).select("month", "down")
    return R.islands(flags, "down")


def outlier_topk(s, d):
    z = X.standardize(V.macro_panel(s, d), ["series"], "value").withColumn("z", F.round("z", 8))
    z = z.join(V.regimes(V.macro_panel(s, d)), "month").filter("label = 0")
    rn = F.row_number().over(W.partitionBy("month").orderBy(F.abs("z").desc(), "series"))
    return z.withColumn("place", rn).filter("place <= 10").select("month", "series", "z", "place")


def conditional_sharpe(s, d):
    r = _returns(s, d)
    return P.conditional_sharpe(r.join(V.regimes(r), "month"), ["label", "ticker"]).select("label", "ticker", "n", r8("mean"), r8("sd"), F.round("score", 6).alias("score"), "status")


def sample_covariance(s, d):
    return P.covariance(_returns(s, d)).select("a", "b", F.round("cov", 10).alias("cov"))


def shrunk_covariance(s, d):
    return P.covariance(_returns(s, d), 0.1, 1e-8).select("a", "b", F.round("cov", 10).alias("cov"))


def _scores(s, d):
    return P.trailing_scores(_returns(s, d))


def allocate_lo(s, d):
    return P.allocate(_scores(s, d), 2, "lo").select("month", "ticker", r8("weight"))


def allocate_lns(s, d):
    return P.allocate(_scores(s, d), 3, "lns").select("month", "ticker", r8("weight"))


def allocate_los(s, d):
    return P.allocate(_scores(s, d), 4, "los").select("month", "ticker", r8("weight"))


def allocate_mixed(s, d):
    r = _returns(s, d)
    return P.allocate_mixed(P.trailing_scores(r), V.regimes(r), 2).select("month", "ticker", r8("weight"))


def benchmark_weights(s, d):
    return P.benchmark_weights(_returns(s, d), "1F").select("strategy", "month", "ticker", r8("weight"))


def volatility_scaling(s, d):
    r = _returns(s, d)
    v = P.volatility_scale(P.allocate(P.trailing_scores(r), 2, "lo"), r)
    return v.select("month", r8("volatility"), r8("gross"), F.round("multiplier", 6).alias("multiplier"), "status")


def grid_weights(s, d):
    """The forecasts of every run under all sizings and sizes: 48 strategies of four models."""
    f = table(s, d, "forecasts").select("run_id", F.col("decision_month").alias("month"), "model", "ticker", F.col("value").alias("score")).distinct()
    g = P.grid_weights(f, V.regimes(f), ["run_id", "month", "model"])
    return g.select("run_id", "month", F.concat_ws("_", "model", "sizing", "size").alias("strategy_id"), "ticker", r8("weight"))


def verify_weights(s, d):
    """Per model and sizing, weights of the grid against weights derived anew: faults."""
    f = table(s, d, "forecasts").select("run_id", F.col("decision_month").alias("month"), "model", "ticker", F.col("value").alias("score")).distinct()
    by = ["run_id", "month", "model"]
    v = P.verify_weights(f, V.regimes(f), P.grid_weights(f, V.regimes(f), by), by)
    return v.groupBy("model", "sizing", "size").agg(F.count("*").alias("groups"), F.sum("missing").alias("missing"), F.sum("unexpected").alias("unexpected"), F.sum("off").alias("off"))


def _two_models(r):
    """(month, model, ticker, score): trailing mean over deviation, and the negative of the last known return."""
    last = r.select(add_month(F.col("month"), 2).alias("month"), F.lit("turn").alias("model"), "ticker", (-F.col("r")).alias("score"))
    sc = P.trailing_scores(r).select("month", F.lit("trend").alias("model"), "ticker", "score")
    return cut(sc.unionByName(last.join(r.select("month", "ticker"), ["month", "ticker"], "left_semi")))


def _grid_held(s, d):
    """Weights of all strategies of two models and of the benchmarks, and the returns they meet."""
    r = _returns(s, d)
    sc = _two_models(r)
    g = P.grid_weights(sc, V.regimes(r)).select(F.concat_ws("_", "model", "sizing", "size").alias("strategy"), "month", "ticker", "weight")
    ids = sc.select("model", "month").distinct().withColumn("strategy", F.explode(F.transform(F.array(*[F.lit(x) for x in P.strategy_ids([""])]), lambda i: F.concat(F.col("model"), i))))
    # a month without a choice is held in cash, not left out
    empty = ids.select("strategy", "month").join(g, ["strategy", "month"], "left_anti").join(r.groupBy("month").agg(F.min("ticker").alias("ticker")), "month").withColumn("weight", F.lit(0.0))
    bench = P.benchmark_weights(r, "1F")
    return g.unionByName(empty).unionByName(bench), r


def strategy_grid(s, d):
    """Every strategy of the grid and both benchmarks from scores to performance, in one plan."""
    w, r = _grid_held(s, d)
    a = P.account_without_costs(w, r, ["strategy"]).drop("wealth", "drawdown")
    p = P.performance(a, ["strategy"], "month", "net", "turnover")
    return p.select("strategy", "n_months", *[F.round(c, 6).alias(c) for c in ("cagr", "ann_vol", "sharpe", "sortino", "maxdd", "avgdd", "mean_turnover")])


def verify_metrics(s, d):
    """Metrics of all stored accounts against ones made anew: the differences found."""
    a = table(s, d, "monthly_account").select("run_id", "strategy_id", "holding_month", "net_return").distinct()
    p = P.performance(a, ["run_id", "strategy_id"], "holding_month", "net_return")
    return P.verify_metrics(a, p, ["run_id", "strategy_id"], "holding_month", "net_return").groupBy("metric").agg(F.count("*").alias("off"))


def account_full(s, d):
    """A leveraged and a long-short strategy with every cost: trading, borrowing, financing, interest on cash, real days."""
    r = _returns(s, d)
    w = _held(r, "lo").withColumn("weight", F.col("weight") * 1.1).unionByName(_held(r, "los").withColumn("weight", F.col("weight") * 0.3))
    a = P.account(w, r, ["strategy"], cost_bps=10, borrow=0.02, financing=0.03, cash_rate=0.01, days=T.month_days(T.exchange_sessions(s)), gross_cap=2.0, gaps=True)
    return a.select("strategy", "month", F.col("days").cast("int").alias("days"), *[r8(c) for c in ("turnover", "gross", "transaction_cost", "borrow_cost", "financing_cost", "cash_return", "net", "gross_exposure", "net_exposure", "wealth", "drawdown")])


def _held(r, sizing="lo"):
    """Weights for every ticker of every month with scores, 0 where not held."""
    sc = P.trailing_scores(r)
    return sc.select("month", "ticker").join(P.allocate(sc, 2, sizing), ["month", "ticker"], "left").select(F.lit(f"naive_{sizing}_2").alias("strategy"), "month", "ticker", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def account_without_costs(s, d):
    r = _returns(s, d)
    a = P.account_without_costs(_held(r), r, ["strategy"])
    return a.select("strategy", "month", r8("net"), r8("turnover"), r8("gross_exposure"), r8("net_exposure"), r8("wealth"), r8("drawdown"))


def account_with_costs(s, d):
    r = _returns(s, d)
    w = P.benchmark_weights(r, "1F").filter("strategy = 'ew'")
    a = P.account(w, r, ["strategy"], cost_bps=10, gaps=True)
    return a.select("strategy", "month", r8("turnover"), r8("gross"), r8("cost"), r8("net"), r8("wealth"), r8("drawdown"))


def strategy_backtest(s, d):
    """The whole chain in one plan: prices, returns, trailing scores, top two, ledger, performance."""
    r = _returns(s, d)
    p = P.performance(P.account_without_costs(_held(r), r, ["strategy"]).drop("wealth", "drawdown"), ["strategy"], "month", "net", "turnover")
    return p.select("strategy", "n_months", *[F.round(c, 6).alias(c) for c in ("cagr", "ann_vol", "sharpe", "sortino", "maxdd", "avgdd", "mean_turnover")])


def wealth_drawdown(s, d):
    a = table(s, d, "monthly_account").select("run_id", "strategy_id", "holding_month", "net_return").distinct()
    return P.wealth(a, ["run_id", "strategy_id"], "holding_month", "net_return").select("run_id", "strategy_id", "holding_month", r8("wealth"), r8("drawdown"))


def performance_metrics(s, d):
    a = table(s, d, "monthly_account").drop("wealth", "drawdown").distinct()
    cost = F.col("transaction_cost") + F.col("borrow_cost") + F.col("financing_cost")
    p = P.performance(a, ["run_id", "strategy_id"], "holding_month", "net_return", "turnover", cost)
    return p.select("run_id", "strategy_id", "n_months", "start_month", "end_month", *[F.round(c, 6).alias(c) for c in ("cagr", "ann_vol", "sharpe", "sortino", "maxdd", "avgdd", "avgdd_all_months", "positive_ratio", "mean_turnover", "total_cost")])


def verify_ledger(s, d):
    return P.verify_ledger(table(s, d, "monthly_account").distinct(), ["run_id", "strategy_id"], "holding_month", atol=1e-5)


def _indexed(r):
    """(ticker, idx, x): returns by the number of their month among the months of the panel, and how many months there are."""
    months = r.select("month").distinct()
    idx = months.withColumn("idx", (F.row_number().over(W.orderBy("month")) - 1).cast("long"))  # bounded by the calendar
    return r.join(idx, "month").select("ticker", "idx", F.col("r").alias("x")), months.count()


DRAWS = 1000


def block_indices(s, d):
    return S.block_indices(s, _indexed(_returns(s, d))[1], 12, DRAWS)


def _draws(s, d):
    x, months = _indexed(_returns(s, d))
    return S.resampled_metrics(S.block_indices(s, months, 12, DRAWS), x, ["ticker"])


def bootstrap_metrics(s, d):
    return _draws(s, d).select("ticker", "draw", *[F.round(c, 6).alias(c) for c in ("sharpe", "sortino", "maxdd", "positive_ratio")])


def bootstrap_intervals(s, d):
    return S.interval(_draws(s, d), ["ticker"], "sharpe").select("ticker", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "valid", "excluded")


def _pairs(s, d):
    return _paired(_returns(s, d))


def _paired(r):
    base = r.filter("ticker = '1F'").select("month", F.col("r").alias("b"))
    return r.filter("ticker <> '1F'").select("month", "ticker", F.col("r").alias("a")).join(base, "month")


def paired_statistics(s, d):
    return S.paired_statistics(_pairs(s, d), ["ticker"]).select("ticker", "n", F.round("t", 6).alias("t"), r8("mean_rank_a"), F.round("z", 6).alias("z"), "reason")


def holm_adjusted(s, d):
    p = S.with_pvalues(S.paired_statistics(_pairs(s, d), ["ticker"]))
    return p.select("ticker", *[F.round(c, 7).alias(c) for c in ("p_t", "p_nemenyi", "holm_t", "holm_nemenyi")])


def paired_pvalues(s, d):
    p = S.paired_statistics(_pairs(s, d), ["ticker"])
    return p.select("ticker", F.round(S.student_tail(F.col("t"), F.col("n") - 1), 7).alias("p_t"), F.round(S.normal_tail(F.col("z")), 7).alias("p_nemenyi"))


def _compared(s, d):
    """Two pairs of series: one asset against the other assets of its status as controls, one against a single control."""
    x, months = _indexed(_returns(s, d))
    full = x.groupBy("ticker").agg(F.count("*").alias("n")).filter(F.col("n") == months).select("ticker")
    x = x.join(full, "ticker", "left_semi")
    side = lambda pair, kind, rows, seed: rows.select(F.lit(pair).alias("pair"), F.lit(kind).alias("side"), seed.alias("seed"), "idx", "x")
    controls = x.filter("ticker like '%O' and ticker <> '1O'")
    number = F.dense_rank().over(W.partitionBy("idx").orderBy("ticker")) - 1
    out = side("many", "treatment", x.filter("ticker = '1O'"), F.lit(0)).unionByName(side("many", "control", controls, number))
    return out.unionByName(side("one", "treatment", x.filter("ticker = '3O'"), F.lit(0))).unionByName(side("one", "control", x.filter("ticker = '1O'"), F.lit(0))), months


def profile_intervals(s, d):
    c = S.compare_pairs(*_compared(s, d))
    return c.select("pair", "metric", "block", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "valid", "excluded")


def profile_originals(s, d):
    c = S.original_metrics(*_compared(s, d))
    return c.select("pair", "metric", F.round("treatment", 6).alias("treatment"), F.round("control_mean", 6).alias("control_mean"), "defined", "excluded")


def profile_tests(s, d):
    p = S.with_pvalues(S.paired_by_draws(*_compared(s, d)))
    return p.select("pair", "metric", "n", F.round("t", 6).alias("t"), F.round("z", 6).alias("z"), "p_t", "p_nemenyi", "holm_t", "holm_nemenyi", "reason")


REPRESENTATIVES = ("naive_lo_2", "ridge_lo_2", "bl_lo_2", "mvo_lo_2")


def _variant_ledger(s, st, returns, settings, account, fixed=None):
    f = D.window_forecasts(st, returns, settings, fixed).filter("regime is null and value is not null").select(F.col("decision_month").alias("month"), "model", "ticker", F.col("value").alias("score"))
    modal = st.select(F.col("decision_month").alias("month"), (F.array_position("next_p", F.array_max("next_p")) - 1).cast("int").alias("label"))
    g = P.grid_weights(f, modal, sizings=("lo",), sizes=(2,)).select(F.concat_ws("_", "model", "sizing", "size").alias("strategy"), "month", "ticker", "weight").join(returns.select("month", "ticker"), ["month", "ticker"], "left_semi")
    gross = account.pop("scaled", None)
    if gross is not None:
        v = P.volatility_scale(g, returns, by=["strategy"], **gross).filter("status = 'ok'")
        g = g.join(v.select("strategy", "month", "multiplier"), ["strategy", "month"]).withColumn("weight", F.col("weight") * F.col("multiplier")).drop("multiplier")
    return P.account(g, returns, ["strategy"], gaps=True, days=T.month_days(T.exchange_sessions(s)), **account)


def sensitivity(s, d):
    """Each variant's metrics less the baseline's over the months they share, for the four representative strategies."""
    panel, returns = _features(s, d), _returns(s, d)
    base = D.Settings(missing_rate=0.6, starts=4)
    dec = cut(_decisions(s, d, panel, returns, D.Settings(missing_rate=0.6, lag=3)))
    out = None
    ledgers, fitted = {}, {}

    def states(settings):
        """States by what their fit depends on; variants of later steps share them."""
        key = (settings.lag, settings.missing_rate, settings.limit, settings.variance)
        if key not in fitted:
            fitted[key] = cut(D.window_states(panel, D.outer_windows(dec, s=settings), settings, strict=False).filter("reason is null"))
        return fitted[key]

    for name, (settings, account, curve) in D.sensitivity_variants(base).items():
        fixed = None
        if name == "validation_forward":
            fixed = D.forward_lambdas(D.forward_errors(D.window_states(panel, D.inner_windows(dec), settings, strict=False).filter("reason is null"), returns, settings))
        key = "scaled" if curve == "scaled" else "plain"
        if key not in ledgers:
            ledgers[key] = cut(_variant_ledger(s, states(base), returns, base, {"scaled": {}} if key == "scaled" else {}))
        a, b = S.common_difference(ledgers[key], cut(_variant_ledger(s, states(settings), returns, settings, dict(account), fixed)), ["strategy"], "month", "net")
        m = lambda x, tag: P.performance(x.drop("wealth", "drawdown"), ["strategy"], "month", "net").select("strategy", *[F.col(c).alias(f"{tag}_{c}") for c in S.METRICS], F.col("n_months").alias(f"{tag}_n"))
        one = m(a, "a").join(m(b, "b"), "strategy").select(F.lit(name).alias("variant"), "strategy", F.col("a_n").alias("n_months"), *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(c) for c in S.METRICS])
        out = one if out is None else out.unionByName(one)
    return out


def ridge_line(s, d):
    x = _pairs(s, d).select("ticker", F.col("b").alias("x"), F.col("a").alias("y"))
    return N.ridge_line(x, "ticker", 0.5).select("ticker", "n", r8("slope"), r8("intercept"), r8("loo_mse"))


def lambda_choice(s, d):
    x = _pairs(s, d).select("ticker", F.col("b").alias("x"), F.col("a").alias("y"))
    tried = N.ridge_line_grid(x, "ticker", N.lambda_grid())
    return N.least_error(tried, ["ticker"], "lam", "loo_mse").select("ticker", r8("lam"))


def _windows(s, d, train=48):
    r = V.asset_returns(s, d)
    m = r.select("month").distinct()
    first = m.agg(F.min("month").alias("first"))
    at = m.crossJoin(F.broadcast(first)).filter(month_index(F.col("month")) >= month_index(F.col("first")) + train + 1).drop("first")
    return training_windows(at.withColumnRenamed("month", "decision_month"), "decision_month", train).select("decision_month", F.col("target_month").alias("month"))


def pca_windows(s, d):
    z = X.standardize(V.asset_returns(s, d), ["ticker"], "r")
    return N.window_components(_windows(s, d).join(z, "month").withColumnRenamed("ticker", "series"), "decision_month")


def pca_variance(s, d):
    """Variance of each window's full set of component scores; SQL takes it from the standardized returns themselves."""
    z = X.standardize(V.asset_returns(s, d), ["ticker"], "r")
    full = z.groupBy("ticker").agg(F.count("*").alias("n"))
    z = z.join(full.join(full.agg(F.max("n").alias("most")), how="cross").filter("n = most").select("ticker"), "ticker", "left_semi")
    c = N.window_components(_windows(s, d).join(z, "month").withColumnRenamed("ticker", "series"), "decision_month", threshold=1.0)
    return c.groupBy("decision_month").agg(F.count_distinct("month").alias("months"), F.round(F.sum(F.pow("score", 2)) / F.count_distinct("month"), 6).alias("variance"))


def two_asset_views(s, d):
    """Black-Litterman and mean-variance directions of every asset paired with 1F over all their common months, by the window's own forecast."""
    r = _returns(s, d)
    r = r.join(V.regimes(r), "month")
    pair = r.filter("ticker <> '1F'").select(F.col("ticker").alias("pair"), "month", "label", F.col("r").alias("a")).join(r.filter("ticker = '1F'").select("month", F.col("r").alias("b")), "month")
    settings = D.Settings(models=("bl", "mvo"))

    def fit(pdf):
        import numpy as np
        import pandas as pd

        y, labels = pdf[["a", "b"]].to_numpy(), pdf["label"].to_numpy()
        p = np.bincount(labels, minlength=6) / len(labels)
        rows = D.forecast(np.zeros((len(y), 1)), y, np.zeros(1), labels, p, settings)
        return pd.DataFrame([(pdf["pair"].iloc[0], m, ("own", "1F")[j], v) for m, j, regime, v, *_ in rows if regime is None], columns=["pair", "model", "asset", "value"])

    return pair.groupBy("pair").applyInPandas(fit, "pair string, model string, asset string, value double").select("pair", "model", "asset", F.round("value", 6).alias("value"))


def window_partitions(s, d):
    return N.window_partition(pca_windows(s, d), "decision_month")


# the panel of nations has real gaps, up to half of its cells in small data
SETTINGS = D.Settings(missing_rate=0.6)


def r8_of(x):
    return F.round(x, 8)



def _features(s, d):
    """(base_month, series, y, grp): the transformed macro panel."""
    m = V.macro_panel(s, d)
    y = X.transform_series(m, ["series"], "month", "value", "tcode")
    return cut(y.join(m.groupBy("series").agg(F.max("grp").alias("grp")), "series").select(F.col("month").alias("base_month"), "series", "y", "grp"))


def _decisions(s, d, panel, returns, settings=SETTINGS):
    """(month): decisions for which the panel and the returns reach back far enough."""
    a = panel.agg(F.min(month_index(F.col("base_month"))).alias("a"), F.max(month_index(F.col("base_month"))).alias("b"))
    r = returns.agg(F.min(month_index(F.col("month"))).alias("c"))
    i = month_index(F.col("month"))
    ends = a.join(r, how="cross")  # one row
    return returns.select("month").distinct().join(ends, how="cross").filter((i - settings.train - 1 >= F.col("c")) & (i - settings.train - 2 - settings.lag >= F.col("a")) & (i - settings.lag - 1 <= F.col("b"))).select("month")


def _states(s, d):
    panel, returns = _features(s, d), _returns(s, d)
    return cut(D.window_states(panel, D.outer_windows(_decisions(s, d, panel, returns)), SETTINGS)), panel, returns


def window_states(s, d):
    st, _, _ = _states(s, d)
    return st.select("decision_month", "first_target", "rows", F.size("columns").alias("series"), F.size("ratio").alias("components"), "counts", "skipped", "state_id")


def window_labels(s, d):
    return D.state_rows(_states(s, d)[0])


def window_probabilities(s, d):
    return D.probability_rows(_states(s, d)[0])


def window_forecasts(s, d):
    st, _, returns = _states(s, d)
    return D.window_forecasts(st, returns, SETTINGS)


def window_balance(s, d):
    """What every window must satisfy, per decision: rows, months read after the cutoff, probabilities that don't sum to 1, labels that don't fit the rows, forecasts per model."""
    st, _, returns = _states(s, d)
    f = cut(D.window_forecasts(st, returns, SETTINGS))
    off = lambda c: F.when(F.abs(F.aggregate(c, F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9, 1).otherwise(0)
    late = F.size(F.filter("fit_months", lambda m: month_index(m) > month_index(F.col("decision_month")) - 4))
    a = st.select("decision_month", "rows", late.alias("late"), (off(F.col("current_p")) + off(F.col("next_p"))).alias("sums_off"), F.when(F.size("labels") == F.col("rows"), 0).otherwise(1).alias("labels_off"))
    n = f.filter("regime is null").groupBy("decision_month").agg(F.count_distinct("model").alias("models"), F.count_if((F.col("status") != "missing_history") & F.col("value").isNull()).alias("empty"), (F.count("*") / F.count_distinct("model")).cast("long").alias("tickers"))
    # the final ridge forecast is the sum of its conditional ones weighted by the next probabilities
    p = D.probability_rows(st).select("decision_month", "regime", "next_probability")
    mix = f.filter("model = 'ridge' and regime is not null").join(p, ["decision_month", "regime"]).groupBy("decision_month", "ticker").agg(F.sum(F.col("value") * F.col("next_probability")).alias("mix"))
    ridge = f.filter("model = 'ridge' and regime is null").join(mix, ["decision_month", "ticker"]).groupBy("decision_month").agg(F.count_if(F.abs(F.col("mix") - F.col("value")) > 1e-10).alias("mix_off"))
    return a.join(n, "decision_month").join(ridge, "decision_month", "left").na.fill({"mix_off": 0})


def regime_ridge(s, d):
    """The window's regime-wise ridge with given states, so that SQL can follow it: one predictor (the panel's total), labels by month number, shares of labels as next probabilities, penalty 0.5."""
    panel, returns = _features(s, d), _returns(s, d)
    total = V.macro_panel(s, d).groupBy("month").agg((F.sum("value") / 1e6).alias("x"))
    dec = D.outer_windows(_decisions(s, d, panel, returns))
    t = training_windows(dec.select("decision_month"), "decision_month").join(V.regimes(returns).withColumnRenamed("month", "target_month"), "target_month")
    t = t.join(total.select(F.col("month").alias("predictor_base_month"), "x"), "predictor_base_month")
    rows = t.groupBy("decision_month").agg(F.array_sort(F.collect_list(F.struct("position", "label", "x"))).alias("z"))
    share = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.size(F.filter("z", lambda e: e["label"] == k)) / 48.0)
    query = total.select(add_month(F.col("month"), 3).alias("decision_month"), F.array("x").alias("current"))
    given = dec.join(rows, "decision_month").join(query, "decision_month").select("decision_month", "window", "first_target", "rows", F.col("z.label").alias("labels"), F.transform("z", lambda e: F.array(e["x"])).alias("predictors"), "current", share.alias("next_p"))
    fixed = dec.select("decision_month").join(returns.select("ticker").distinct(), how="cross").withColumn("lambda", F.lit(0.5))  # decisions times tickers
    f = D.window_forecasts(given, returns, D.Settings(models=("ridge",)), fixed)
    return f.filter("status <> 'missing_history'").groupBy("decision_month", "ticker").agg(r8_of(F.max(F.when(F.col("regime").isNull(), F.col("value")))).alias("value"), F.count_if(F.col("regime").isNotNull() & (F.col("fallback") == "pooled")).alias("pooled"))


def forward_lambdas(s, d):
    panel, returns = _features(s, d), _returns(s, d)
    inner = D.inner_windows(_decisions(s, d, panel, returns))
    quick = D.Settings(missing_rate=0.6, starts=4)  # 24 windows a decision
    return D.forward_lambdas(D.forward_errors(D.window_states(panel, inner, quick), returns, quick))


def random_controls(s, d):
    """Ridge and naive forecasts of two random memberships of every window."""
    st, _, returns = _states(s, d)
    quick = D.Settings(models=("naive", "ridge"))
    return D.window_forecasts(D.with_labels(st, [0, 1]), returns, quick, extra=["seed"]).filter("regime is null").select("seed", "decision_month", "model", "ticker", "value", "status")


def regime_matches(s, d):
    return D.match_states(_states(s, d)[0])


def full_sample(s, d):
    return D.full_sample(_features(s, d), SETTINGS)


def grid_backtest(s, d):
    """From prices and panel to performance: windows, forecasts of four models, 48 strategies and two benchmarks, costs, metrics."""
    st, _, returns = _states(s, d)
    f = cut(D.window_forecasts(st, returns, SETTINGS).filter("regime is null and value is not null").select(F.col("decision_month").alias("month"), "model", "ticker", F.col("value").alias("score")))
    modal = st.select(F.col("decision_month").alias("month"), (F.array_position("next_p", F.array_max("next_p")) - 1).cast("int").alias("label"))
    g = P.grid_weights(f, modal).select(F.concat_ws("_", "model", "sizing", "size").alias("strategy"), "month", "ticker", "weight")
    ids = f.select("month").distinct().withColumn("strategy", F.explode(F.array(*[F.lit(x) for x in P.strategy_ids(SETTINGS.models)])))
    held = returns.join(f.select("month").distinct(), "month", "left_semi")
    empty = ids.join(g, ["strategy", "month"], "left_anti").join(held.groupBy("month").agg(F.min("ticker").alias("ticker")), "month").withColumn("weight", F.lit(0.0)).select("strategy", "month", "ticker", "weight")
    w = g.join(held.select("month", "ticker"), ["month", "ticker"], "left_semi").unionByName(empty).unionByName(P.benchmark_weights(held, "1F"))
    a = P.account(w, returns, ["strategy"], cost_bps=10, borrow=0.02, financing=0.02, days=T.month_days(T.exchange_sessions(s)))
    return P.performance(a.drop("wealth", "drawdown"), ["strategy"], "month", "net", "turnover", F.col("cost"))


QUERIES = {f.__name__: f for f in (
    spherical_centroids, cosine_distances, nearest_center, soft_memberships, combined_probabilities, transition_matrix, conditional_departures, next_probabilities, modal_regime, center_order,
    indicator_means, indicator_minmax, indicator_extremes, downturn_islands, outlier_topk, conditional_sharpe, sample_covariance, shrunk_covariance, allocate_lo, allocate_lns, allocate_los,
    allocate_mixed, benchmark_weights, volatility_scaling, grid_weights, verify_weights, strategy_grid, verify_metrics, account_full, account_without_costs, account_with_costs, strategy_backtest, wealth_drawdown, performance_metrics, verify_ledger, block_indices,
    bootstrap_metrics, bootstrap_intervals, paired_statistics, holm_adjusted, paired_pvalues, profile_intervals, profile_originals, profile_tests, sensitivity, ridge_line, lambda_choice, pca_windows, pca_variance, two_asset_views, window_partitions, window_states, window_labels, window_probabilities, window_forecasts, window_balance, regime_ridge, forward_lambdas, random_controls, regime_matches, full_sample, grid_backtest,
)}

_IND = f"{MACRO}, lab as (select distinct month, (({MI('month')} * 7 + {MI('month')} // 5) % 6)::int as label from macro), im as (select series, label, avg(value) as mean, count(value) as n from macro join lab using (month) group by all)"
_MM = _IND + ", mm as (select series, label, case when max(mean) over w = min(mean) over w then 0 else (mean - min(mean) over w) / nullif(max(mean) over w - min(mean) over w, 0) end as scaled from im window w as (partition by series))"
_COV = lambda shrink, eps: f"with {RET}, cv as (select a.ticker as a, b.ticker as b, covar_samp(a.r, b.r) as c from ret a join ret b using (month) group by all) select a, b, round(case when a = b then c + {eps} else (1 - {shrink}) * c end, 10) as cov from cv"
_LEDGER = LO2 + """, held as (select sc.month, sc.ticker, coalesce(weight, 0) as w, r from sc left join lo2 using (month, ticker) join ret using (month, ticker)),
  hg as (select *, sum(w * r) over (partition by month) as g from held), nx as (select month, lead(month) over (order by month) as nxt from (select distinct month from held)),
  mv as (select month, ticker, sum(w) as d from (select month, ticker, w from held union all select nxt, ticker, -w * (1 + r) / (1 + g) from hg join nx using (month) where nxt is not null) group by all), tv as (select month, sum(abs(d)) as turnover from mv group by 1),
  led as (select month, any_value(g) as net, any_value(turnover) as turnover, sum(abs(w)) as gross_exposure, sum(w) as net_exposure from hg join tv using (month) group by month),
  wl as (select *, product(1 + net) over (order by month rows unbounded preceding) as wealth from led), dd as (select *, wealth / greatest(1, max(wealth) over (order by month rows unbounded preceding)) - 1 as drawdown from wl)"""
_PAIRS = RET + ", pr as (select a.ticker, a.month, a.r as a, b.r as b from ret a join ret b on a.month = b.month and b.ticker = '1F' where a.ticker <> '1F')"
_PSTAT = _PAIRS + ", ps as (select ticker, count(*) as n, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) as t, avg(case when a > b then 1.0 when a < b then 2.0 else 1.5 end) as ra from pr group by 1)"
_BLOCKS = f"""im as (select month, row_number() over (order by month) - 1 as idx from (select distinct month from ret)), nm as (select count(*) as n from im),
  st as (select draw, b, ('0x' || substr(md5('0-' || draw || '-' || b), 1, 8))::bigint % n as s, n from nm, (select unnest(generate_series(0, {DRAWS - 1})) as draw), lateral (select unnest(generate_series(0, (n - 1) // 12)) as b)),
  bi as (select draw, b * 12 + k as position, (s + k) % n as idx from st, (select unnest(generate_series(0, 11)) as k) where b * 12 + k < n)"""
_BOOT = f"""with {RET}, {_BLOCKS}, ix as (select ticker, idx, r as x from ret join im using (month)), j as (select ticker, draw, position, x from bi join ix using (idx)),
  w as (select *, product(1 + x) over (partition by ticker, draw order by position rows unbounded preceding) as w from j), e as (select *, w / greatest(1, max(w) over (partition by ticker, draw order by position rows unbounded preceding)) - 1 as dd from w),
  bm as (select ticker, draw, avg(x) / nullif(stddev_samp(x), 0) * sqrt(12) as sharpe, avg(x) / nullif(sqrt(avg(pow(least(x, 0), 2))), 0) * sqrt(12) as sortino, min(dd) as maxdd, avg((x > 0)::int) as positive_ratio from e group by all)"""
_METRICS = lambda net: f"""exp(ln(arg_max(wealth, month)) * 12 / count(*)) - 1 as cagr, case when count(*) >= 2 then stddev_samp({net}) * sqrt(12) end as ann_vol, case when count(*) >= 2 then avg({net}) / nullif(stddev_samp({net}), 0) * sqrt(12) end as sharpe,
  case when count(*) >= 2 then avg({net}) / nullif(sqrt(avg(pow(least({net}, 0), 2))), 0) * sqrt(12) end as sortino, min(drawdown) as maxdd, coalesce(avg(drawdown) filter (drawdown < 0), 0) as avgdd, avg(drawdown) as avgdd_all_months, avg(({net} > 0)::int) as positive_ratio, avg(turnover) as mean_turnover"""  # noqa: E731
_ACC = """ac as (select distinct run_id, strategy_id, holding_month as month, gross_return, transaction_cost, borrow_cost, financing_cost, cash_return, net_return, turnover, wealth as sw, drawdown as sd from monthly_account),
  aw as (select *, product(1 + net_return) over (partition by run_id, strategy_id order by month rows unbounded preceding) as wealth from ac),
  ad as (select *, wealth / greatest(1, max(wealth) over (partition by run_id, strategy_id order by month rows unbounded preceding)) - 1 as drawdown from aw)"""
_RIDGE = lambda lam: f"""(with g as (select ticker, count(*) n, avg(b) mx, avg(a) my, covar_pop(b, a) * count(*) / (var_pop(b) * count(*) + {lam}) as slope, var_pop(b) * count(*) + {lam} as den from pr group by 1)
  select ticker, n, slope, my - slope * mx as intercept, avg(pow((a - (my - slope * mx) - slope * b) / (1 - 1.0 / n - pow(b - mx, 2) / den), 2)) as loo_mse from pr join g using (ticker) group by ticker, n, slope, my, mx)"""  # noqa: E731

# every sizing and size of scores f(by, ticker, score), label 0 of a month by its number as in views.regimes
_GRID = lambda by: f"""gr as (select *, case when score > 0 then row_number() over (partition by {by}, score > 0 order by score desc, ticker) end as up, case when score < 0 then row_number() over (partition by {by}, score > 0 order by score, ticker) end as down,
  row_number() over (partition by {by} order by abs(score) desc, ticker) as wide, ({MI('month')} * 7 + {MI('month')} // 5) % 6 = 0 as crisis from f),
  gs as (select gr.*, sizing, size from gr, (select unnest(['lo', 'lns', 'los', 'mx']) as sizing), (select unnest([2, 3, 4]) as size) where case sizing when 'lo' then up <= size when 'lns' then up <= size or down <= size when 'los' then wide <= size else case when crisis then wide <= size else up <= size end end),
  gw as (select {by}, sizing, size, ticker, score / sum(abs(score)) over (partition by {by}, sizing, size) as weight from gs)"""  # noqa: E731
_DAYS = f"""hol as (select unnest([{', '.join("'" + h + "'::date" for h in _HOLIDAYS)}]) as d),
  tdays as (select d::date as d from (select unnest(generate_series(date '1990-01-01', date '2025-12-31', interval 1 day)) as d) where dayofweek(d) between 1 and 5 and d::date not in (select d from hol)),
  fsd as (select strftime(d, '%Y-%m') as month, min(d) as d from tdays group by 1), dm as (select month, lead(d) over (order by month) - d as days from fsd)"""
_L2 = lambda a, b, e: f"list_sum(list_transform(list_zip({a}, {b}), lambda t: {e}))"
_FOLD = lambda bps, borrow, fin, cash: f"""gd as (select k.strategy, k.month, t.ticker, coalesce(hw.w, 0)::double as w, coalesce(ret.r, 0)::double as r, days from (select distinct strategy, month from hw) k, (select distinct ticker from ret) t
  left join hw on hw.strategy = k.strategy and hw.month = k.month and hw.ticker = t.ticker left join ret on ret.month = k.month and ret.ticker = t.ticker join dm on dm.month = k.month),
  ml as (select strategy, month, list(w order by ticker) as w, list(r order by ticker) as r, any_value(days)::double as days, row_number() over (partition by strategy order by month) as i from gd group by strategy, month),
  mc as (select *, {_L2('w', 'r', 't[1] * t[2]')} as gross, 1 - list_sum(w) as cash, list_sum(list_transform(w, lambda x: abs(x))) as gross_exposure, list_sum(w) as net_exposure, list_sum(list_transform(w, lambda x: greatest(-x, 0))) * {borrow} * days / 365 as borrow_cost from ml),
  md as (select *, greatest(-cash, 0) * {fin} * days / 365 as financing_cost, greatest(cash, 0) * {cash} * days / 365 as cash_return from mc),
  fold as (select strategy, 0::bigint as i, list_transform(w, lambda x: 0.0::double) as pre, ''::varchar as month, 0.0::double as turnover, 0.0::double as net, 1.0::double as wealth from ml where i = 1
  union all select m.strategy, m.i, list_transform(list_zip(m.w, m.r), lambda t: t[1] * (1 + t[2]) / (1 + n.net)), m.month, n.turnover, n.net, fold.wealth * (1 + n.net) from fold join md m on m.strategy = fold.strategy and m.i = fold.i + 1,
    lateral (select {_L2('m.w', 'fold.pre', 'abs(t[1] - t[2])')} as turnover) u, lateral (select u.turnover as turnover, m.gross + m.cash_return - u.turnover * {bps} / 10000 - m.borrow_cost - m.financing_cost as net) n),
  led as (select md.*, turnover, turnover * {bps} / 10000 as transaction_cost, net, wealth, wealth / greatest(1, max(wealth) over (partition by md.strategy order by md.i)) - 1 as drawdown from fold join md on md.strategy = fold.strategy and md.i = fold.i)"""  # noqa: E731

_DECISIONS = f"""dec as (select distinct month, {MI('month')} as i from ret where {MI('month')} - 49 >= (select min({MI('month')}) from ret) and {MI('month')} - 52 >= (select min({MI('month')}) from macro) and {MI('month')} - 3 <= (select max({MI('month')}) from macro))"""

# tails by Simpson's rule: Student's through the angle atan(t / sqrt(df)), the normal one from 0 to z
_SIMPSON = lambda b, f: f"({b}) / 2000 / 3 * list_sum(list_transform(range(0, 2001), lambda i: (case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end) * ({f(f'(({b}) * i / 2000)')})))"
_PVALUES = _PSTAT + f""", pv as (select ticker, 0.5 - sign(t) * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt(pi()) * {_SIMPSON('atan(abs(t) / sqrt(n - 1))', lambda x: f'pow(cos({x}), n - 2)')} as p_t,
  1 - 2 / sqrt(2 * pi()) * {_SIMPSON('abs(3 - 2 * ra) * sqrt(n)', lambda x: f'exp(-{x} * {x} / 2)')} as p_n from ps)"""
_COMPARED = f"""{RET}, im as (select month, row_number() over (order by month) - 1 as idx from (select distinct month from ret)), nm as (select count(*) as n from im), x0 as (select ticker, idx, r as x from ret join im using (month)),
  fl as (select ticker from x0 group by 1 having count(*) = (select n from nm)), x1 as (select * from x0 where ticker in (select ticker from fl)),
  sr as (select 'many' as pair, 'treatment' as side, 0 as seed, idx, x from x1 where ticker = '1O' union all select 'many', 'control', dense_rank() over (partition by idx order by ticker) - 1, idx, x from x1 where ticker like '%O' and ticker <> '1O'
    union all select 'one', 'treatment', 0, idx, x from x1 where ticker = '3O' union all select 'one', 'control', 0, idx, x from x1 where ticker = '1O')"""
_ALL_BLOCKS = f"""st as (select block, draw, b, ('0x' || substr(md5('0-' || draw || '-' || b), 1, 8))::bigint % n as s, n from nm, (select unnest([12, 6, 24]) as block), (select unnest(generate_series(0, {DRAWS - 1})) as draw), lateral (select unnest(generate_series(0, (n - 1) // block)) as b)),
  bi as (select block, draw, b * block + k as position, (s + k) % n as idx from st, lateral (select unnest(generate_series(0, block - 1)) as k) where b * block + k < n)"""
_BM = """w as (select *, product(1 + x) over (partition by pair, side, seed, block, draw order by position rows unbounded preceding) as w from j), e as (select *, w / greatest(1, max(w) over (partition by pair, side, seed, block, draw order by position rows unbounded preceding)) - 1 as dd from w),
  bm as (select pair, side, seed, block, draw, avg(x) / nullif(stddev_samp(x), 0) * sqrt(12) as sharpe, avg(x) / nullif(sqrt(avg(pow(least(x, 0), 2))), 0) * sqrt(12) as sortino, min(dd) as maxdd, avg((x > 0)::int) as positive_ratio from e group by all),
  lm as (select pair, side, seed, block, draw, unnest(['sharpe', 'sortino', 'maxdd', 'positive_ratio']) as metric, unnest([sharpe, sortino, maxdd, positive_ratio]) as value from bm)"""

SQL = {
    "spherical_centroids": f"with {CEN} select label, unnest(generate_series(0, 63))::int as i, round(unnest(center), 8) as v from cen",
    "cosine_distances": f"with {CEN} select id, label, round(distance, 8) as distance from dist",
    "nearest_center": f"with {CEN} select id, arg_min(label, (distance, label)) as label, round(min(distance), 6) as distance from dist group by id",
    "soft_memberships": f"with {SOFT} select id, label, round(p, 8) as p from soft",
    "combined_probabilities": f"""with {CEN}, l as (select id, list(distance order by label) as d from dist group by id), q as (select id, 1 - d[1] / (d[1] + d[2]) as p0, list_transform(d[3:], lambda v: (1 - v / list_sum(d[3:])) / (len(d) - 3)) as nn from l),
  m as (select id, list_concat([-list_max(nn) * log2(1 - p0)], nn) as v from q) select id, unnest(generate_series(0, len(v) - 1))::int as k, round(unnest(list_transform(v, lambda t: t / list_sum(v))), 8) as p from m""",
    "transition_matrix": f"with {TRANS} select src, dst, n, round(p, 8) as p, round(p_literal, 8) as p_literal, skipped from mat",
    "conditional_departures": f"with {TRANS}, sy as (select src, max(p) filter (src = dst) as stay from mat group by src) select src, dst, round(case when src = dst or stay >= 1 then 0 else p / nullif(1 - stay, 0) end, 8) as p, stay >= 1 as absorbing from mat join sy using (src)",
    "next_probabilities": f"with {SOFT}, {TRANS_OF(10)}, q as (select id, dst as label, sum(soft.p * mat.p) as q from soft join mat on soft.label = mat.src group by all) select id, label, round(q / sum(q) over (partition by id), 8) as p from q",
    "modal_regime": f"with {SOFT} select id, arg_min(label, (-round(p, 9), label)) as label from soft group by id",
    "center_order": f"with {CEN} select label, (row_number() over (order by center) - 1)::int as number from cen",
    "indicator_means": f"with {_IND} select series, label, round(mean, 7) as mean, n from im",
    "indicator_minmax": f"with {_MM} select series, label, round(scaled, 8) as scaled from mm",
    "indicator_extremes": f"with {_MM} select label, arg_max(series, (round(scaled, 9), -series)) as highest, arg_min(series, (round(scaled, 9), series)) as lowest from mm group by label",
    "downturn_islands": f"with {MACRO}, t as (select month, sum(value) v from macro group by 1), f as (select month, coalesce(v < lag(v) over (order by month), false) as down from t), g as (select *, row_number() over (order by month) - row_number() over (partition by down order by month) as k from f) select min(month) as first_month, max(month) as last_month, count(*) as n_months from g where down group by k",
    "outlier_topk": f"""with {_IND}, z as (select month, series, round((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 8) as z from macro window w as (partition by series)), k as (select z.*, row_number() over (partition by month order by abs(z) desc, series) as place from z join lab using (month) where label = 0)
select month, series, z, place::int as place from k where place <= 10""",
    "conditional_sharpe": f"""with {RET}, {LAB}, g as (select label, ticker, count(*) n, avg(r) mean, stddev_samp(r) sd, max(r) hi, min(r) lo from ret join lab using (month) group by all)
select label, ticker, n, round(mean, 8) as mean, round(case when n >= 2 then case when hi = lo then 0 else sd end end, 8) as sd, round(case when n < 2 or hi = lo then 0 else mean / sd end, 6) as score, case when n < 2 or hi = lo then 'undefined' else 'ok' end as status from g""",
    "sample_covariance": _COV(0, 0),
    "shrunk_covariance": _COV(0.1, 1e-8),
    "allocate_lo": f"with {LO2} select month, ticker, round(weight, 8) as weight from lo2",
    "allocate_lns": f"with {SCORES}, k as (select *, row_number() over (partition by month, score > 0 order by abs(score) desc, ticker) as rn from sc where score <> 0) select month, ticker, round(score / sum(abs(score)) over (partition by month), 8) as weight from k where rn <= 3",
    "allocate_los": f"with {SCORES}, k as (select *, row_number() over (partition by month order by abs(score) desc, ticker) as rn from sc where score <> 0) select month, ticker, round(score / sum(abs(score)) over (partition by month), 8) as weight from k where rn <= 4",
    "allocate_mixed": f"""with {LO2}, {LAB}, a as (select *, row_number() over (partition by month order by abs(score) desc, ticker) as rn from sc where score <> 0), los as (select month, ticker, score / sum(abs(score)) over (partition by month) as weight from a where rn <= 2)
select month, ticker, round(weight, 8) as weight from los join lab using (month) where label = 0 union all select month, ticker, round(weight, 8) from lo2 join lab using (month) where label <> 0""",
    "benchmark_weights": f"with {RET} select 'ew' as strategy, month, ticker, round(1.0 / count(*) over (partition by month), 8)::double as weight from ret union all select 'single', month, ticker, (ticker = '1F')::int::double from ret",
    "volatility_scaling": f"""with {LO2}, h as (select month, count(*) as held, sum(abs(weight)) as gross from lo2 group by 1),
  ps as (select l.month, {MI('l.month')} - {MI('r.month')} as o, sum(l.weight * r.r) as x, count(*) as n from lo2 l join ret r on r.ticker = l.ticker and {MI('r.month')} between {MI('l.month')} - 49 and {MI('l.month')} - 2 group by all),
  v as (select ps.month, count(*) as n, sqrt(12 * var_samp(x) filter (o <= 37)) as vol from ps join h on h.month = ps.month and ps.n = h.held group by 1)
select h.month, case when v.n = 48 then round(vol, 8) end as volatility, round(gross, 8) as gross, case when v.n = 48 then round(case when vol = 0 or gross = 0 then 0 else least(0.1 / nullif(vol, 0), 2 / nullif(gross, 0)) end, 6) end as multiplier,
  case when coalesce(v.n, 0) = 48 then 'ok' else 'insufficient_history' end as status from h left join v using (month)""",
    "grid_weights": f"""with f as (select distinct run_id, decision_month as month, model, ticker, value as score from forecasts where value is not null and not isnan(value) and not isinf(value) and value <> 0), {_GRID('run_id, month, model')}
select run_id, month, model || '_' || sizing || '_' || size as strategy_id, ticker, round(weight, 8) as weight from gw""",
    "verify_weights": f"""with f as (select distinct run_id, decision_month as month, model, ticker, value as score from forecasts where value is not null and not isnan(value) and not isinf(value) and value <> 0), {_GRID('run_id, month, model')}
select model, sizing, size, count(distinct (run_id, month)) as groups, 0::bigint as missing, 0::bigint as unexpected, 0::bigint as off from gw group by all""",
    "strategy_grid": f"""with {SCORES}, f as (select month, 'trend' as model, ticker, score from sc where score <> 0 union all select a.month, 'turn', a.ticker, -b.r from ret a join ret b on b.ticker = a.ticker and {MI('b.month')} = {MI('a.month')} - 2 where b.r <> 0), {_GRID('month, model')},
  hw as (select model || '_' || sizing || '_' || size as strategy, month, ticker, weight as w from gw union all select 'ew', month, ticker, 1.0 / count(*) over (partition by month) from ret union all select 'single', month, ticker, (ticker = '1F')::int from ret),
  ids as (select distinct model || '_' || sizing || '_' || size as strategy, month from (select month, model from f group by all), (select unnest(['lo', 'lns', 'los', 'mx']) as sizing), (select unnest([2, 3, 4]) as size) union select 'ew', month from ret union select 'single', month from ret),
  hr as (select hw.*, r from hw join ret using (month, ticker)), hg as (select *, sum(w * r) over (partition by strategy, month) as g from hr), he as (select *, w * (1 + r) / (1 + g) as e from hg),
  ix as (select *, lead(month) over (partition by strategy order by month) as nxt from ids), dr as (select i.strategy, i.nxt as month, ticker, e from he join ix i using (strategy, month) where i.nxt is not null),
  tu as (select strategy, month, sum(abs(coalesce(hr.w, 0) - coalesce(dr.e, 0))) as turnover from hr full outer join dr using (strategy, month, ticker) group by all),
  led as (select i.strategy, i.month, coalesce(any_value(g), 0) as net from ids i left join hg using (strategy, month) group by all), lt as (select led.*, coalesce(turnover, 0) as turnover from led left join tu using (strategy, month)),
  wl as (select *, product(1 + net) over (partition by strategy order by month rows unbounded preceding) as wealth from lt), dd as (select *, wealth / greatest(1, max(wealth) over (partition by strategy order by month rows unbounded preceding)) - 1 as drawdown from wl),
  p as (select strategy, count(*) as n_months, {_METRICS('net')} from dd group by strategy) select strategy, n_months, """ + ", ".join(f"round({c}, 6) as {c}" for c in ("cagr", "ann_vol", "sharpe", "sortino", "maxdd", "avgdd", "mean_turnover")) + " from p",
    "verify_metrics": "select 'none' as metric, 0::bigint as off where false",
    "account_full": f"""with recursive {LO2}, {_DAYS}, a4 as (select *, row_number() over (partition by month order by abs(score) desc, ticker) as rn from sc where score <> 0), los as (select month, ticker, score / sum(abs(score)) over (partition by month) as weight from a4 where rn <= 2),
  hw as (select 'naive_lo_2' as strategy, sc.month, sc.ticker, 1.1 * coalesce(weight, 0) as w from sc left join lo2 using (month, ticker) union all select 'naive_los_2', sc.month, sc.ticker, 0.3 * coalesce(weight, 0) from sc left join los using (month, ticker)), {_FOLD(10, 0.02, 0.03, 0.01)}
select strategy, month, days::int as days, """ + ", ".join(f"round({c}, 8) as {c}" for c in ("turnover", "gross", "transaction_cost", "borrow_cost", "financing_cost", "cash_return", "net", "gross_exposure", "net_exposure", "wealth", "drawdown")) + " from led",
    "account_without_costs": f"with {_LEDGER} select 'naive_lo_2' as strategy, month, " + ", ".join(f"round({c}, 8) as {c}" for c in ("net", "turnover", "gross_exposure", "net_exposure", "wealth", "drawdown")) + " from dd",
    "pca_variance": f"""with {RET}, n as (select ticker, count(*) as n from ret group by 1), z as (select month, ticker, (r - avg(r) over w) / nullif(stddev_pop(r) over w, 0) as z from ret where ticker in (select ticker from n where n = (select max(n) from n)) window w as (partition by ticker)),
  dec as (select distinct month, {MI('month')} as i from ret where {MI('month')} - 49 >= (select min({MI('month')}) from ret)), x as (select dec.month as decision_month, z.* from dec join z on {MI('z.month')} between dec.i - 49 and dec.i - 2),
  v as (select decision_month, ticker, var_pop(z) as v, count(*) as k from x group by all) select decision_month, max(k) as months, round(sum(v), 6) as variance from v group by 1""",
    "two_asset_views": f"""with {RET}, {LAB}, pr as (select a.ticker as pair, label, a.r as a, b.r as b from ret a join ret b on a.month = b.month and b.ticker = '1F' join lab on lab.month = a.month where a.ticker <> '1F'),
  m as (select pair, avg(a) as ma, avg(b) as mb, var_samp(a) + 1e-8 as saa, var_samp(b) + 1e-8 as sbb, 0.9 * covar_samp(a, b) as sab from pr group by 1),
  c as (select pair, label, count(*) as n, avg(a) as qa, avg(b) as qb from pr group by all), k as (select pair, arg_min(struct_pack(n := n, qa := qa, qb := qb), (-n, label)) as k from c group by 1),
  g as (select m.*, k.k.n as n, case when k.k.n < 2 then ma else k.k.qa end as qa, case when k.k.n < 2 then mb else k.k.qb end as qb from m join k using (pair)),
  h as (select *, 0.05 * saa + saa / greatest(n, 1) as haa, 0.05 * sbb + sbb / greatest(n, 1) as hbb, 0.05 * sab as hab from g), i as (select *, haa * hbb - hab * hab as det from h),
  e as (select *, (hbb * (qa - ma) - hab * (qb - mb)) / det as ea, (haa * (qb - mb) - hab * (qa - ma)) / det as eb from i),
  p as (select *, ma + 0.05 * (saa * ea + sab * eb) as pa, mb + 0.05 * (sab * ea + sbb * eb) as pb, 3 * (saa * sbb - sab * sab) as dd from e)
select pair, 'mvo' as model, 'own' as asset, round((sbb * ma - sab * mb) / dd, 6) as value from p union all select pair, 'mvo', '1F', round((saa * mb - sab * ma) / dd, 6) from p
union all select pair, 'bl', 'own', round((sbb * pa - sab * pb) / dd, 6) from p union all select pair, 'bl', '1F', round((saa * pb - sab * pa) / dd, 6) from p""",
    "window_balance": f"""with {RET}, {MACRO}, {_DECISIONS}, k as (select dec.month, ret.ticker from dec join ret on {MI('ret.month')} between dec.i - 49 and dec.i - 2 group by all)
select month as decision_month, 48 as rows, 0 as late, 0 as sums_off, 0 as labels_off, 4::bigint as models, 0::bigint as empty, count(*) as tickers, 0::bigint as mix_off from k group by month""",
    "regime_ridge": f"""with {RET}, {MACRO}, {_DECISIONS}, {LAB}, b as (select {MI('month')} as i, sum(value) / 1e6 as x from macro group by 1),
  t as (select dec.month as m, dec.i as mi, ret.ticker, label, b.x, ret.r as y from dec join ret on {MI('ret.month')} between dec.i - 49 and dec.i - 2 join lab on lab.month = ret.month join b on b.i = {MI('ret.month')} - 3),
  full_t as (select m, ticker from t group by all having count(*) = 48),
  g as (select m, mi, ticker, label, count(*) as n, avg(x) as mx, avg(y) as my, covar_pop(x, y) * count(*) as sxy, var_pop(x) * count(*) as sxx from t join full_t using (m, ticker) group by all),
  a as (select m, ticker, avg(x) as mx, avg(y) as my, covar_pop(x, y) * count(*) as sxy, var_pop(x) * count(*) as sxx from t join full_t using (m, ticker) group by all),
  q as (select full_t.*, r as label from full_t, (select unnest([1, 2, 3, 4, 5]) as r)),
  f as (select q.m, q.ticker, coalesce(g.n, 0) as n, case when coalesce(g.n, 0) >= 6 then g.my + g.sxy / (g.sxx + 0.5) * (b.x - g.mx) else a.my + a.sxy / (a.sxx + 0.5) * (b.x - a.mx) end as pred
    from q left join g using (m, ticker, label) join a using (m, ticker) join b on b.i = {MI('q.m')} - 3)
select m as decision_month, ticker, round(sum(n / 48.0 * pred), 8) as value, count(*) filter (n < 6) as pooled from f group by all""",
    "account_with_costs": f"""with recursive {RET}, dm as (select distinct month, 30 as days from ret), hw as (select 'ew' as strategy, month, ticker, 1.0 / count(*) over (partition by month) as w from ret), {_FOLD(10, 0, 0, 0)}
select strategy, month, round(turnover, 8) as turnover, round(gross, 8) as gross, round(transaction_cost, 8) as cost, round(net, 8) as net, round(wealth, 8) as wealth, round(drawdown, 8) as drawdown from led""",
    "strategy_backtest": f"with {_LEDGER}, p as (select count(*) as n_months, {_METRICS('net')} from dd) select 'naive_lo_2' as strategy, n_months, " + ", ".join(f"round({c}, 6) as {c}" for c in ("cagr", "ann_vol", "sharpe", "sortino", "maxdd", "avgdd", "mean_turnover")) + " from p",
    "wealth_drawdown": f"with {_ACC} select run_id, strategy_id, month as holding_month, round(wealth, 8) as wealth, round(drawdown, 8) as drawdown from ad",
    "performance_metrics": f"with {_ACC}, p as (select run_id, strategy_id, count(*) as n_months, min(month) as start_month, max(month) as end_month, {_METRICS('net_return')}, sum(transaction_cost + borrow_cost + financing_cost) as total_cost from ad group by all) select run_id, strategy_id, n_months, start_month, end_month, "
    + ", ".join(f"round({c}, 6) as {c}" for c in ("cagr", "ann_vol", "sharpe", "sortino", "maxdd", "avgdd", "avgdd_all_months", "positive_ratio", "mean_turnover", "total_cost")) + " from p",
    "verify_ledger": f"""with {_ACC} select run_id, strategy_id, count(*) as n_rows, count(*) filter (coalesce(abs(gross_return + cash_return - transaction_cost - borrow_cost - financing_cost - net_return) > 1e-5 + 1e-8 * abs(net_return), true)) as net_off,
  count(*) filter (coalesce(abs(wealth - sw) > 1e-5 + 1e-8 * abs(sw), true)) as wealth_off, count(*) filter (coalesce(abs(drawdown - sd) > 1e-5 + 1e-8 * abs(sd), true)) as drawdown_off from ad group by all""",
    "block_indices": f"with {RET}, {_BLOCKS} select draw, position::int as position, idx from bi",
    "bootstrap_metrics": _BOOT + " select ticker, draw, round(sharpe, 6) as sharpe, round(sortino, 6) as sortino, round(maxdd, 6) as maxdd, round(positive_ratio, 6) as positive_ratio from bm",
    "bootstrap_intervals": _BOOT + " select ticker, round(quantile_cont(sharpe, 0.025), 6) as low, round(quantile_cont(sharpe, 0.975), 6) as high, count(sharpe) as valid, count(*) - count(sharpe) as excluded from bm group by ticker",
    "paired_statistics": f"with {_PSTAT} select ticker, n, round(t, 6) as t, round(ra, 8)::double as mean_rank_a, round(abs(3 - 2 * ra) / sqrt(1.0 / n), 6) as z, null::varchar as reason from ps",
    "paired_pvalues": f"with {_PVALUES} select ticker, round(p_t, 7) as p_t, round(p_n, 7) as p_nemenyi from pv",
    "holm_adjusted": f"""with {_PVALUES}, h as (select *, least(1, p_t * (count(*) over () - row_number() over (order by p_t, ticker) + 1)) as st, least(1, p_n * (count(*) over () - row_number() over (order by p_n, ticker) + 1)) as sn from pv)
select ticker, round(p_t, 7) as p_t, round(p_n, 7) as p_nemenyi, round(max(st) over (order by p_t, ticker rows unbounded preceding), 7) as holm_t, round(max(sn) over (order by p_n, ticker rows unbounded preceding), 7) as holm_nemenyi from h""",
    "profile_originals": f"""with {_COMPARED}, j as (select pair, side, seed, idx as position, 0 as block, 0 as draw, x from sr), {_BM}
select pair, metric, round(max(value) filter (side = 'treatment'), 6) as treatment, round(avg(value) filter (side = 'control'), 6) as control_mean, count(value) filter (side = 'control') as defined, count(*) filter (side = 'control' and value is null) as excluded from lm group by all""",
    "profile_intervals": f"""with {_COMPARED}, {_ALL_BLOCKS}, j as (select pair, side, seed, position, block, draw, x from bi join sr using (idx)), {_BM},
  df as (select pair, metric, block, draw, max(value) filter (side = 'treatment') - avg(value) filter (side = 'control') as v from lm group by all)
select pair, metric, block::int as block, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high, count(v) as valid, count(*) - count(v) as excluded from df group by all""",
    "ridge_line": f"with {_PAIRS} select ticker, n, round(slope, 8) as slope, round(intercept, 8) as intercept, round(loo_mse, 8) as loo_mse from {_RIDGE(0.5)}",
    "lambda_choice": f"with {_PAIRS}, grid as (select pow(10, -4 + i * 0.2) as lam from (select unnest(generate_series(0, 40)) as i)), g as (select ticker, count(*) n, avg(b) mx, avg(a) my, covar_pop(b, a) * count(*) as sxy, var_pop(b) * count(*) as sxx from pr group by 1), t as (select ticker, lam, avg(pow((a - my - sxy / (sxx + lam) * (b - mx)) / (1 - 1.0 / n - pow(b - mx, 2) / (sxx + lam)), 2)) as loo_mse from pr join g using (ticker), grid group by all), m as (select *, min(loo_mse) over (partition by ticker) as least_mse from t) select ticker, round(max(lam), 8) as lam from m where loo_mse <= least_mse * (1 + 1e-12) group by ticker",
}
