"""Whole runs from pinned datasets: one plan over all months, its tables in a checked run folder, and what is made of them later."""

from __future__ import annotations

import hashlib
import platform
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.months import month_index
from ..operators import constraints as C, portfolio as P, statistics as S, timing as T, transforms as X, windows as D
from ..operators.constraints import ContractError
from ..session import cut
from ..sources import datasets, files
from ..sources.config import Config
from ..sources.sinks import RunFolder, publish

# Columns, keys and nullable columns of a run's tables.
TABLES = {
    "probabilities": (("run_id", "decision_month", "partition_id", "regime_id", "current_probability", "next_probability"), ("run_id", "decision_month", "regime_id"), ()),
    "conditional_forecasts": (("run_id", "decision_month", "partition_id", "model", "ticker", "regime_id", "value", "score_kind", "raw_n", "effective_n", "selected_lambda", "fallback", "status", "reason"), ("run_id", "decision_month", "model", "ticker", "regime_id"), ("selected_lambda",)),
    "forecasts": (("run_id", "decision_month", "partition_id", "model", "ticker", "value", "score_kind", "status", "reason"), ("run_id", "decision_month", "model", "ticker"), ()),
    "weights": (("run_id", "decision_month", "strategy_id", "ticker", "base_weight", "target_weight"), ("run_id", "decision_month", "strategy_id", "ticker"), ()),
    "returns": (("run_id", "holding_month", "strategy_id", "decision_at", "execution_at", "target_end", "gross_return", "transaction_cost", "borrow_cost", "financing_cost", "cash_return", "net_return", "turnover", "gross_exposure", "net_exposure", "wealth", "drawdown"), ("run_id", "holding_month", "strategy_id"), ()),
    "asset_returns": (("month", "ticker", "r"), ("month", "ticker"), ()),
}
METRIC_COLUMNS = ["cagr", "ann_vol", "sharpe", "sortino", "maxdd", "avgdd", "avgdd_all_months", "positive_ratio", "mean_turnover", "total_cost", "cash_ratio", "sharpe_reason", "sortino_reason"]
SMOKE_MONTH = "2020-04"


class Context:
    """What all runs of a configuration's data share, read once: prices, returns, vintages, sessions. counts says how often each was made."""

    def __init__(self, spark: SparkSession, config: Config):
        d, r = config.data, config.research
        self.spark, self.counts = spark, {}
        self.sessions = T.exchange_sessions(spark)
        self.days = cut(T.month_days(self.sessions))
        prices = datasets.load_prices(spark, d.root, d.yahoo_dataset_id)
        datasets.check_prices(prices, d.tickers)
        self.returns = cut(datasets.returns_of(prices, self.sessions))
        self.macro = cut(datasets.load_macro(spark, d.root, d.fred_dataset_id, r.lag_months))
        self.vintages = cut(self.macro.select("vintage_month").distinct())
        self._states: dict = {}

    def months(self, config: Config, smoke: bool = False) -> DataFrame:
        """(month): the configured months from the first feasible one on; smoke: the first, 2020-04 and the last."""
        r = config.research
        start = datasets.feasible_start(self.returns, self.vintages, r.train_months, r.lag_months)
        if start is None:
            raise ContractError("no month is feasible")
        m = self.returns.select("month").distinct().filter(F.col("month").between(max(start, r.start_month), r.end_month))
        if not smoke:
            return m
        a, b = m.agg(F.min("month"), F.max("month")).first()
        return m.filter(F.col("month").isin(a, SMOKE_MONTH, b))

    def states(self, config: Config, months: DataFrame, tag: str, inner: bool = False) -> tuple[DataFrame, DataFrame]:
        """(ledger, states) of a configuration's months; equal settings share their states."""
        s, r = config.settings(), config.research
        key = (replace(s, models=(), lambdas=(), shrink=0, eps=1, tau=1, omega=1, delta=1, fallback=""), r.profile, tag, inner)
        if key not in self._states:
            self.counts["states_made"] = self.counts.get("states_made", 0) + 1
            fixed = config.data.fixed_vintage if r.profile == "fixed_snapshot" else None
            w = D.inner_windows(months, s=s) if inner else D.outer_windows(months, s=s)
            ledger = cut(T.decision_ledger(w.select(F.col("window").alias("month")).distinct(), self.vintages, self.sessions, "month", s.train, s.lag, fixed))
            bad = ledger.filter(F.col("vintage").isNull() | ~F.col("targets_ended") | ~F.col("bases_known") | ~F.coalesce("vintage_available", F.lit(True))).select("month").limit(1).collect()
            if bad:
                raise ContractError(f"timing rules are broken at {bad[0][0]}")
            w = w.join(ledger.select(F.col("month").alias("window"), "vintage"), "window")
            used = self.macro.join(w.select(F.col("vintage").alias("vintage_month")).distinct(), "vintage_month", "left_semi")
            y = X.transform_series(used, ["vintage_month", "series"], "base_month", "value", "tcode")
            groups = used.groupBy("vintage_month", "series").agg(F.max("macro_group").alias("grp"))
            panel = y.join(groups, ["vintage_month", "series"]).select(F.col("vintage_month").alias("vintage"), "base_month", "series", "y", "grp")
            self._states[key] = (ledger, cut(D.window_states(panel, w, s)))
        else:
            self.counts["states_shared"] = self.counts.get("states_shared", 0) + 1
        return self._states[key]

    def fixed_lambdas(self, config: Config, months: DataFrame, tag: str) -> DataFrame:
        """Penalties chosen by forward validation, only from returns that have ended before the decision."""
        _, inner = self.states(config, months, tag, inner=True)
        return D.forward_lambdas(D.forward_errors(inner, self.returns, config.settings()))


def books(context: Context, config: Config, ledger: DataFrame, states: DataFrame, tag: str, fixed: DataFrame | None = None, extra: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """forecasts, base and scaled weights and accounts of all strategies of a configuration; `extra` names further keys of the states."""
    r, p, extra = config.research, config.portfolio, list(extra)
    if r.validation == "blocked" and fixed is None:
        fixed = context.fixed_lambdas(config, ledger.select("month"), tag)
    f = cut(D.window_forecasts(states, context.returns, config.settings(), fixed, extra))
    if not f.filter("status = 'missing_history'").isEmpty():
        raise ContractError("a ticker lacks returns of a training window")
    scores = f.filter("regime is null").select(*extra, F.col("decision_month").alias("month"), "model", "ticker", F.col("value").alias("score"))
    modal = states.select(*extra, F.col("decision_month").alias("month"), (F.array_position("next_p", F.array_max("next_p")) - 1).cast("int").alias("label"))
    by = [*extra, "month", "model"]
    if extra:  # one grid per value of the extra keys, by a combined month key
        tagged = F.concat_ws("#", "month", *extra)
        scores, modal = scores.withColumn("_at", tagged), modal.withColumn("month", tagged).select("month", "label")
        g = P.grid_weights(scores, modal, [*by, "_at"], "_at", r.strategies, r.selection_sizes)
    else:
        g = P.grid_weights(scores, modal, by, "month", r.strategies, r.selection_sizes)
    g = g.select(*extra, F.concat_ws("_", "model", "sizing", "size").alias("strategy"), "month", "ticker", "weight")
    panel = context.returns.join(states.select(F.col("decision_month").alias("month")).distinct(), "month", "left_semi")
    cells = scores.select(*extra, "month", "ticker").distinct().withColumn("strategy", F.explode(F.array(*[F.lit(x) for x in P.strategy_ids(r.models, r.strategies, r.selection_sizes)])))
    base = cells.join(g, [*extra, "strategy", "month", "ticker"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    if not extra:
        base = base.unionByName(P.benchmark_weights(panel, config.data.tickers[0]).withColumn("strategy", F.when(F.col("strategy") == "single", config.data.tickers[0].lower()).otherwise(F.col("strategy"))))
    base = cut(base)
    v = P.volatility_scale(base, context.returns, p.vol_lookback, p.vol_target, p.gross_cap, r.train_months, [*extra, "strategy"])
    scaled = base.join(v.select(*extra, "strategy", "month", "multiplier", "status"), [*extra, "strategy", "month"]).withColumn("target", F.col("weight") * F.coalesce("multiplier", F.lit(0.0)))
    keys = [*extra, "strategy"]
    run = lambda w, cap: P.account(w, context.returns, keys, days=context.days, gross_cap=cap, **config.costs(), gaps=tag == "smoke")
    return {
        "forecasts": f, "weights": scaled.select(*keys, "month", "ticker", F.col("weight").alias("base_weight"), "target"), "scaling": v,
        "account": cut(run(base, 1.0 + 1e-9)), "scaled_account": cut(run(scaled.drop("weight").withColumnRenamed("target", "weight"), p.gross_cap + 1e-9)),
    }


def _returns_table(account: DataFrame, ledger: DataFrame, run_id: str) -> DataFrame:
    j = account.join(ledger.select("month", "decision_at", "execution_at", F.col("target_end_at").alias("target_end")), "month")
    return j.select(F.lit(run_id).alias("run_id"), F.col("month").alias("holding_month"), F.col("strategy").alias("strategy_id"), "decision_at", "execution_at", "target_end", F.col("gross").alias("gross_return"), "transaction_cost", "borrow_cost", "financing_cost", "cash_return", F.col("net").alias("net_return"), "turnover", "gross_exposure", "net_exposure", "wealth", "drawdown")


def _metrics(account: DataFrame) -> DataFrame:
    p = P.performance(account.drop("wealth", "drawdown"), ["strategy"], "month", "net", "turnover", F.col("cost"))
    cash = account.groupBy("strategy").agg((F.count_if(F.col("gross_exposure") == 0) / F.count("*")).alias("cash_ratio"))
    return p.join(cash, "strategy").select(F.col("strategy").alias("strategy_id"), "n_months", "start_month", "end_month", *METRIC_COLUMNS)


def provenance() -> dict:
    """Digests of this package's code and the versions it runs under."""
    root = Path(__file__).resolve().parents[1]
    code = {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.py"))}
    import numpy
    import pyspark

    return {"code": files.content_id(code), "files": len(code), "python": sys.version.split()[0], "platform": platform.system(), "pyspark": pyspark.__version__, "numpy": numpy.__version__}


def run(spark: SparkSession, config: Config, output: str, smoke: bool = False, context: Context | None = None) -> dict:
    """One backtest into a new run folder: states, probabilities, forecasts, weights, accounts (base and scaled), metrics."""
    run_id = files.content_id({"config": config.record(), "smoke": smoke})
    folder = RunFolder(output, run_id, {"config": config.record(), "smoke": smoke, "provenance": provenance()})
    try:
        context = context or Context(spark, config)
        months = cut(context.months(config, smoke))
        tag = "smoke" if smoke else "all"
        ledger, states = context.states(config, months, tag)
        b = books(context, config, ledger, states, tag)
        rid = F.lit(run_id).alias("run_id")
        part = states.select("decision_month", F.col("state_id").alias("partition_id"))
        f = b["forecasts"].join(part, "decision_month").withColumn("regime_id", F.concat(F.lit("R"), "regime"))
        name = lambda t, df, **kw: folder.write(t, df, *TABLES[kw.pop("like", t)], **kw)
        name("asset_returns", context.returns)
        folder.write("states", states, states.columns, ["decision_month", "window"], ["reason"])
        folder.write("ledgers", ledger, ledger.columns, ["month"], ["vintage_available"], form="json")
        probability = D.probability_rows(states).join(part, "decision_month")
        name("probabilities", probability.select(rid, "decision_month", "partition_id", F.concat(F.lit("R"), "regime").alias("regime_id"), "current_probability", "next_probability"), form="csv")
        name("conditional_forecasts", f.filter("regime is not null").select(rid, "decision_month", "partition_id", "model", "ticker", "regime_id", "value", "score_kind", "raw_n", "effective_n", F.col("lambda").alias("selected_lambda"), "fallback", "status", "reason"))
        order = F.create_map(*[F.lit(x) for i, m in enumerate(config.research.models) for x in (m, i)])
        name("forecasts", f.filter("regime is null").select(rid, "decision_month", "partition_id", "model", "ticker", "value", "score_kind", "status", "reason").orderBy("decision_month", F.element_at(order, F.col("model")), "ticker"))
        name("weights", b["weights"].select(rid, F.col("month").alias("decision_month"), F.col("strategy").alias("strategy_id"), "ticker", "base_weight", F.col("target").alias("target_weight")))
        name("returns", _returns_table(b["account"], ledger, run_id))
        name("scaled_returns", _returns_table(b["scaled_account"], ledger, run_id), like="returns")
        for t, a in (("metrics", b["account"]), ("scaled_metrics", b["scaled_account"])):
            m = _metrics(a)
            folder.write(t, m, m.columns, ["strategy_id"], METRIC_COLUMNS)
        folder.manifest["counts"] = context.counts
    except Exception as e:
        folder.close(str(e)[:2000] or type(e).__name__)
        raise
    folder.close()
    return {"run_id": run_id, "status": "succeeded", "path": output}


def load_states(spark: SparkSession, path: str) -> DataFrame:
    """The fitted states of a run, or ContractError if one's content isn't what its id says."""
    states = spark.read.parquet(f"{path}/states")
    if not D.require_intact(states).isEmpty():
        raise ContractError("a stored state was changed")
    return states


def verify(spark: SparkSession, path: str) -> dict:
    """Recompute a finished run from its own tables: contents, states, weights, ledgers, metrics. Returns checks and errors."""
    manifest = RunFolder.verify(spark, path)
    table = lambda t: spark.read.parquet(f"{path}/{t}")
    c = manifest["config"]["config"]
    checks, errors = ["tables are as written"], []

    def check(name: str, faults: int) -> None:
        checks.append(name)
        if faults:
            errors.append(f"{name}: {faults} faults")

    states = load_states(spark, path)
    f = table("forecasts").select(F.col("decision_month").alias("month"), "model", "ticker", F.col("value").alias("score"))
    modal = states.select(F.col("decision_month").alias("month"), (F.array_position("next_p", F.array_max("next_p")) - 1).cast("int").alias("label"))
    parts = F.split("strategy_id", "_")
    stored = table("weights").filter("base_weight <> 0").withColumn("p", parts).filter(F.size("p") == 3).select(F.col("decision_month").alias("month"), F.col("p")[0].alias("model"), F.col("p")[1].alias("sizing"), F.col("p")[2].cast("int").alias("size"), "ticker", F.col("base_weight").alias("weight"))
    want = P.verify_weights(f, modal, stored, sizes=tuple(c["research"]["selection_sizes"])).filter(F.col("sizing").isin(list(c["research"]["strategies"])))
    check("weights follow from forecasts", want.agg(F.sum(F.col("missing") + F.col("unexpected") + F.col("off"))).first()[0] or 0)
    p = c["portfolio"]
    for t, column in (("returns", "base_weight"), ("scaled_returns", "target_weight")):
        a = table(t)
        w = table("weights").select(F.col("strategy_id").alias("strategy"), F.col("decision_month").alias("month"), "ticker", F.col(column).alias("weight"))
        off = ledger_faults(w, table("asset_returns"), a, p)
        check(f"{t} follow from weights", off)
        k = P.verify_ledger(a, ["strategy_id"], "holding_month").agg(F.sum(F.col("net_off") + F.col("wealth_off") + F.col("drawdown_off"))).first()[0] or 0
        check(f"{t} add up", k)
        metrics = table("metrics" if t == "returns" else "scaled_metrics")
        check(f"metrics of {t}", P.verify_metrics(a, metrics, ["strategy_id"], "holding_month", "net_return").count())
    s = table("forecasts").groupBy("decision_month", "ticker").agg(F.count_distinct("model").alias("n")).filter(F.col("n") != len(c["research"]["models"])).count()
    check("every ticker has every model", s)
    return {"status": "failed" if errors else "succeeded", "checks": checks, "errors": errors}


def ledger_faults(weights: DataFrame, returns: DataFrame, stored: DataFrame, costs: dict, rtol: float = 1e-8, atol: float = 1e-10) -> int:
    """Rows of a stored ledger whose figures don't follow from weights, returns and the stored net returns of the month before.

    Another way than the fold: what was held drifts by the month's own stored net return, so each month needs only the one before it.
    """
    m = stored.select(F.col("strategy_id").alias("strategy"), F.col("holding_month").alias("month"), "net_return", "execution_at", "target_end")
    m = m.withColumn("i", month_index(F.col("month")))
    j = weights.join(returns, ["month", "ticker"]).join(m, ["strategy", "month"])
    drift = j.select("strategy", (F.col("i") + 1).alias("i"), "ticker", F.lit(0.0).alias("weight"), (F.col("weight") * (1 + F.col("r")) / (1 + F.col("net_return"))).alias("pre"))
    moved = j.select("strategy", "i", "ticker", "weight", F.lit(0.0).alias("pre")).unionByName(drift).groupBy("strategy", "i", "ticker").agg((F.sum("weight") - F.sum("pre")).alias("d")).groupBy("strategy", "i").agg(F.sum(F.abs("d")).alias("turnover_"))
    g = j.groupBy("strategy", "i", "month").agg(F.sum(F.col("weight") * F.col("r")).alias("gross_"), F.sum("weight").alias("net_"), F.sum(F.abs("weight")).alias("exposure_"), F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).alias("short_"), F.first(T.holding_days(F.col("execution_at"), F.col("target_end"))).alias("days_"))
    year, cash = F.col("days_") / 365, 1 - F.col("net_")
    want = {
        "turnover": F.col("turnover_"), "gross_return": F.col("gross_"), "gross_exposure": F.col("exposure_"), "net_exposure": F.col("net_"), "transaction_cost": F.col("turnover_") * costs["transaction_cost_bps"] / 1e4,
        "borrow_cost": F.col("short_") * costs["borrow_rate"] * year, "financing_cost": F.greatest(-cash, F.lit(0.0)) * costs["financing_rate"] * year, "cash_return": F.greatest(cash, F.lit(0.0)) * costs["cash_rate"] * year,
    }
    full = stored.withColumnsRenamed({"strategy_id": "strategy", "holding_month": "month"}).join(g, ["strategy", "month"], "left").join(moved, ["strategy", "i"], "left")
    bad = None
    for c, e in want.items():
        one = ~F.coalesce(F.abs(F.col(c) - e) <= atol + rtol * F.abs(e), F.lit(False))
        bad = one if bad is None else bad | one
    return full.filter(bad).count()


def suite(spark: SparkSession, config: Config, output: str, smoke: bool = False) -> dict:
    """Both profiles: the main run's representatives, random membership controls and every declared sensitivity, compared over the months all of them share."""
    folder = RunFolder(output, files.content_id({"suite": config.record(), "smoke": smoke}), {"config": config.record(), "smoke": smoke})
    try:
        context, out = Context(spark, config), {"intervals": None, "originals": None, "tests": None, "sensitivity": None}
        n = config.suite
        seeds = list(range(2 if smoke else n.control_repetitions))
        size = n.representative_size
        reps = [f"{m}_{n.representative_strategy}_{size}" for m in config.research.models]

        def add(name: str, profile: str, df: DataFrame) -> None:
            df = cut(df.select(F.lit(profile).alias("profile"), *df.columns))
            out[name] = df if out[name] is None else out[name].unionByName(df)

        for profile in ("fixed_snapshot", "vintage_lagged"):
            cfg = replace(config, research=replace(config.research, profile=profile, strategies=(n.representative_strategy,), selection_sizes=(size,)))
            lags = replace(cfg, research=replace(cfg.research, lag_months=3))
            months = cut(C.common_to_all(context.months(cfg).withColumn("v", F.lit("main")).unionByName(context.months(lags).withColumn("v", F.lit("lag_3"))), [], "v", "month"))
            ledger, states = context.states(cfg, months, "suite")
            main = books(context, cfg, ledger, states, "suite")
            number = months.withColumn("idx", F.row_number().over(_ordered()) - 1)
            count = months.count()
            control = books(context, replace(cfg, research=replace(cfg.research, models=tuple(m for m in cfg.research.models if m in ("naive", "ridge")))), ledger, cut(D.with_labels(states, seeds)), "suite", extra=("seed",))["account"]
            line = lambda df, pair, side, strategy, seed: df.filter(F.col("strategy") == strategy).join(number, "month").select(F.lit(pair).alias("pair"), F.lit(side).alias("side"), seed.alias("seed"), F.col("idx").cast("long").alias("idx"), F.col("net").alias("x"))
            series = None
            for m in ("naive", "ridge"):
                rep = f"{m}_{n.representative_strategy}_{size}"
                if rep in reps:
                    both = line(main["account"], f"{m}_vs_random", "treatment", rep, F.lit(0)).unionByName(line(control, f"{m}_vs_random", "control", rep, F.col("seed")))
                    series = both if series is None else series.unionByName(both)
            a, b = (f"{m}_{n.representative_strategy}_{size}" for m in ("bl", "mvo"))
            if a in reps and b in reps:
                both = line(main["account"], "bl_vs_mvo", "treatment", a, F.lit(0)).unionByName(line(main["account"], "bl_vs_mvo", "control", b, F.lit(0)))
                series = both if series is None else series.unionByName(both)
            if series is not None:
                series = cut(series)
                draws = 8 if smoke else n.bootstrap_repetitions
                add("intervals", profile, S.compare_pairs(series, count, (n.bootstrap_block_months, *n.bootstrap_sensitivity_blocks), draws, n.bootstrap_seed))
                add("originals", profile, S.original_metrics(series, count))
                add("tests", profile, S.with_pvalues(S.paired_by_draws(series, count, n.bootstrap_block_months, n.auxiliary_seed)))
            for name, (settings, account, curve) in D.sensitivity_variants(cfg.settings()).items():
                if name in n.sensitivity_variants:
                    v = books(context, _variant(cfg, name, settings, account), *context.states(_variant(cfg, name, settings, account), months, "suite"), "suite")
                    which = "scaled_account" if curve == "scaled" else "account"
                    x, y = S.common_difference(main[which], v[which], ["strategy"], "month", "net")
                    add("sensitivity", profile, metric_differences(x, y).filter(F.col("strategy").isin(reps)).withColumn("variant", F.lit(name)))
        for name, df in out.items():
            if df is not None:
                folder.write(name, df, df.columns, [], df.columns)
        folder.manifest["counts"] = context.counts
    except Exception as e:
        folder.close(str(e)[:2000] or type(e).__name__)
        raise
    folder.close()
    return {"status": "succeeded", "path": output, "controls": len(seeds)}


def _ordered():
    from pyspark.sql import Window

    return Window.orderBy("month")  # bounded by the calendar


def _variant(cfg: Config, name: str, settings: D.Settings, account: dict) -> Config:
    r = replace(cfg.research, lag_months=settings.lag, missing_rate=settings.missing_rate, ffill_limit=settings.limit, pca_variance=settings.variance, fallback=settings.fallback, cov_shrink=settings.shrink, omega_scale=settings.omega, validation="blocked" if name == "validation_forward" else cfg.research.validation)
    p = cfg.portfolio
    if "cost_bps" in account:
        p = replace(p, transaction_cost_bps=account["cost_bps"], borrow_rate=account["borrow"], financing_rate=account["financing"])
    scaled = account.get("scaled", {})
    return replace(cfg, research=r, portfolio=replace(p, gross_cap=scaled.get("cap", p.gross_cap), vol_lookback=scaled.get("lookback", p.vol_lookback)))


def metric_differences(base: DataFrame, variant: DataFrame) -> DataFrame:
    """(strategy, n_months, a metric each): the variant's metrics less the base's."""
    m = lambda x, tag: P.performance(x.drop("wealth", "drawdown"), ["strategy"], "month", "net").select("strategy", *[F.col(c).alias(f"{tag}_{c}") for c in ("n_months", *S.METRICS)])
    return m(base, "a").join(m(variant, "b"), "strategy").select("strategy", F.col("a_n_months").alias("n_months"), *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(c) for c in S.METRICS])


def figure_data(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The data behind a run's figures: wealth curves, regimes over time, transitions as edges, explained variance."""
    states = load_states(spark, path)
    curve = lambda t: spark.read.parquet(f"{path}/{t}").select("strategy_id", "holding_month", "wealth", "drawdown").orderBy("strategy_id", "holding_month")
    edges = states.select("decision_month", F.posexplode("transition").alias("src", "row")).select("decision_month", "src", F.posexplode("row").alias("dst", "p")).filter("p > 0")
    return {"wealth": curve("returns"), "scaled_wealth": curve("scaled_returns"), "regimes": D.state_rows(states).orderBy("decision_month", "position"), "transitions": edges, "explained": states.select("decision_month", F.posexplode("ratio").alias("component", "ratio"))}


def report(spark: SparkSession, path: str, output: str) -> str:
    """Describe a finished run or suite in a new folder outside of it: report.md, its metrics and figure data. Says nothing about correctness; that is verify's."""
    target = Path(output).resolve()
    if target == Path(path).resolve() or Path(path).resolve() in target.parents:
        raise ContractError("the report must lie outside the run")
    manifest = RunFolder.verify(spark, path)
    target.mkdir(parents=True, exist_ok=False)
    lines = [f"# {manifest['run_id']}", "", "| table | rows |", "|-|-|", *[f"| {n} | {t['rows']} |" for n, t in sorted(manifest["tables"].items())], ""]
    for t in ("metrics", "scaled_metrics"):
        if t in manifest["tables"]:
            m = spark.read.parquet(f"{path}/{t}").orderBy("strategy_id").toPandas()  # one row a strategy
            m.to_csv(target / f"{t}.csv", index=False)
            show = lambda v: "" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)
            cols = ["strategy_id", "n_months", "cagr", "ann_vol", "sharpe", "sortino", "maxdd", "positive_ratio"]
            lines += [f"## {t}", "", f"| {' | '.join(cols)} |", "|" + "-|" * len(cols), *["| " + " | ".join(show(r[c]) for c in cols) + " |" for r in m.to_dict("records")], ""]
            good = m[m["sharpe"].notna()]
            if len(good):
                best = good.loc[good["sharpe"].idxmax()]
                lines += [f"Greatest Sharpe ratio: {best['strategy_id']}, {best['sharpe']:.3f}, chosen after the fact among {len(good)} strategies.", ""]
    for t in ("intervals", "originals", "tests", "sensitivity"):
        if t in manifest["tables"]:
            spark.read.parquet(f"{path}/{t}").toPandas().to_csv(target / f"{t}.csv", index=False)  # one row a pair, metric and variant
            lines += [f"[{t}]({t}.csv)", ""]
    if "states" in manifest["tables"]:
        for name, df in figure_data(spark, path).items():
            df.write.mode("errorifexists").parquet(str(target / "figures" / name))
    publish(str(target / "report.md"), "\n".join(lines).encode())
    return str(target)
