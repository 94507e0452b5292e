"""A whole run on a small invented market: accepted snapshots, backtest, verification, suite, report."""

import json
import zipfile

import numpy as np
import pytest

from vintaloom import cli
from vintaloom.operators import timing as T
from vintaloom.operators.constraints import ContractError
from vintaloom.plans import engine
from vintaloom.sources import arrays, config, datasets, sinks

TICKERS = ["AAA", "BBB", "CCC"]
FIRST, LAST, VINTAGES = "2010-01", "2014-09", ["2013-12", "2014-01", "2014-02", "2014-03", "2014-04", "2014-05", "2014-06", "2014-07"]


def months(a, b):
    i, j = int(a[:4]) * 12 + int(a[5:]) - 1, int(b[:4]) * 12 + int(b[5:]) - 1
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(i, j + 1)]


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("market")
    rng = np.random.default_rng(11)
    days = [r["session"] for r in T.first_sessions(T.exchange_sessions(spark, 2010, 2014)).filter(f"month <= '{LAST}'").orderBy("session").collect()]
    src = root / "prices"
    src.mkdir()
    for t in TICKERS:
        px = 100 * np.exp(np.cumsum(rng.normal(0.005, 0.04, len(days))))
        rows = [f"{d},{x},{x * 1.01},{x * 0.99},{x},{x},1000" for d, x in zip(days, px)]
        (src / f"{t}.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n" + "\n".join(rows) + "\n")
    (src / "manifest.json").write_text(json.dumps({"tickers": TICKERS, "parameters": {"auto_adjust": False, "actions": True}, "fetched_at_utc": "20150101T000000Z"}))
    macro = root / "macro"
    macro.mkdir()
    base = months("2009-01", "2014-08")
    values = {s: np.cumsum(rng.normal(0, 1, len(base))) + 50 for s in "UVWXYZ"}
    with zipfile.ZipFile(macro / "v.zip", "w") as z:
        z.writestr("appendix.csv", "group,fred\n" + "\n".join(f"{i % 4 + 1},{s}" for i, s in enumerate(values)))
        for v in VINTAGES:
            n = base.index(v)  # a vintage ends with the month before its own
            body = [f"{int(m[5:])}/1/{m[:4]}," + ",".join(f"{values[s][i]:.6f}" for s in values) for i, m in enumerate(base[:n])]
            z.writestr(f"{v}.csv", "sasdate," + ",".join(values) + "\nTransform:," + ",".join("1221451"[: len(values)]) + "\n" + "\n".join(body) + "\n")
    (root / "flag.csv").write_text("d,v\n" + "\n".join(f"{m}-01,{i % 2}" for i, m in enumerate(base)) + "\n")
    (root / "c.toml").write_text(
        f'output_root = "runs"\n[data]\nroot = "store"\ntickers = {json.dumps(TICKERS)}\nfixed_vintage = "2014-07"\n[research]\nstart_month = "2014-01"\nend_month = "2014-07"\nn_init = 2\nlambda_count = 5\nselection_sizes = [2]\n'
        '[portfolio]\ntransaction_cost_bps = 10.0\nborrow_rate = 0.02\nfinancing_rate = 0.03\ncash_rate = 0.01\n[suite]\nsensitivity_variants = ["cov_shrink_0", "cost_25bp", "gross_cap_1"]\nbootstrap_sensitivity_blocks = [2]\nbootstrap_block_months = 3\n'
    )
    for provider, source in ((datasets.PRICES, src), (datasets.MACRO, macro), (datasets.INDICATOR, root / "flag.csv")):
        assert cli.main(["data", "accept", "--config", str(root / "c.toml"), "--provider", provider, "--source", str(source)]) == 0
    return root


@pytest.fixture(scope="module")
def finished(spark, market):
    assert cli.main(["run", "--config", str(market / "c.toml"), "--output", str(market / "run")]) == 0
    return str(market / "run")


def test_datasets(spark, market, capsys):
    assert cli.main(["data", "validate", "--config", str(market / "c.toml")]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["macro_vintages"] == len(VINTAGES) and told["first_decision"] == "2014-02" and told["unfinished"] == []
    store = str(market / "store")
    with pytest.raises(ContractError):  # the same content again
        datasets.accept_macro(store, str(market / "macro"))
    with pytest.raises(ContractError):
        datasets.accept_prices(spark, store, str(market / "prices"), TICKERS[:2])
    one = datasets.load_macro(spark, store, vintage="2014-01")
    assert {r[0] for r in one.select("vintage_month").distinct().collect()} == {"2014-01"} and one.agg({"base_month": "max"}).first()[0] == "2013-12"
    flags = datasets.load_indicator(spark, store)
    with pytest.raises(ContractError):
        datasets.indicator_for(flags, spark.createDataFrame([("2020-01",)], "month string"))


def test_run_and_verify(spark, market, finished, capsys):
    table = lambda t: spark.read.parquet(f"{finished}/{t}")
    assert {r["strategy_id"] for r in table("metrics").collect()} == {f"{m}_{z}_2" for m in ("naive", "ridge", "bl", "mvo") for z in ("lo", "lns", "los", "mx")} | {"aaa", "ew"}
    assert sorted(r[0] for r in table("returns").select("holding_month").distinct().collect()) == months("2014-02", "2014-07")
    assert table("returns").filter("borrow_cost > 0").count() > 0 and table("scaled_returns").filter("financing_cost > 0").count() > 0
    assert cli.main(["verify", "--run", finished]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["errors"] == []
    assert cli.main(["report", "--run", finished, "--output", str(market / "report")]) == 0 and "Greatest Sharpe" in (market / "report" / "report.md").read_text()
    assert cli.main(["report", "--run", finished, "--output", finished + "/r"]) == 4
    assert cli.main(["run", "--config", str(market / "c.toml"), "--output", finished]) == 3  # never written again


def test_wrong_figures_are_found(spark, finished):
    from pyspark.sql import functions as F

    a, w, r = (spark.read.parquet(f"{finished}/{t}") for t in ("returns", "weights", "asset_returns"))
    costs = {"transaction_cost_bps": 10.0, "borrow_rate": 0.02, "financing_rate": 0.03, "cash_rate": 0.01}
    w = w.select(F.col("strategy_id").alias("strategy"), F.col("decision_month").alias("month"), "ticker", F.col("base_weight").alias("weight"))
    assert engine.ledger_faults(w, r, a, costs) == 0
    wrong = a.withColumn("turnover", F.when(F.col("strategy_id") == "ew", F.col("turnover") + 1e-6).otherwise(F.col("turnover")))
    assert engine.ledger_faults(w, r, wrong, costs) == 6


def test_suite(spark, market):
    assert cli.main(["suite", "--config", str(market / "c.toml"), "--output", str(market / "suite"), "--smoke"]) == 0
    s = spark.read.parquet(str(market / "suite" / "sensitivity"))
    assert {r[0] for r in s.select("variant").distinct().collect()} == {"cov_shrink_0", "cost_25bp", "gross_cap_1"}
    assert s.filter("variant = 'cost_25bp' and sharpe >= 0").count() == 0 and s.filter("variant = 'cov_shrink_0' and strategy = 'naive_lo_2' and sharpe <> 0").count() == 0
    t = spark.read.parquet(str(market / "suite" / "tests"))
    assert {(r["profile"], r["pair"]) for r in t.collect()} == {(p, q) for p in ("fixed_snapshot", "vintage_lagged") for q in ("naive_vs_random", "ridge_vs_random", "bl_vs_mvo")}


def test_configuration(tmp_path):
    def load(text):
        (tmp_path / "x.toml").write_text(text)
        return config.load_config(str(tmp_path / "x.toml"))

    assert load("[research]\nlag_months = 1\ntau = 1").research.tau == 1.0 and len(load("").settings().lambdas) == 41
    for bad in ("[research]\nlag_months = 4", "[research]\nlag_months = 1.0", "[research]\nnope = 1", "[other]", "[portfolio]\nborrow_rate = -0.1", "[research]\nstart_month = '2020-1'", "not toml", "[suite]\nsensitivity_variants = ['x']"):
        with pytest.raises(ContractError):
            load(bad)


@pytest.mark.parametrize("change", [("Transform:", "Codes:"), ("1/1/2020", "1/2/2020"), ("2/1/2020", "3/1/2020"), (",B\n", ",A\n"), (",2\n", ",8\n"), ("5,6", "5,x"), ("5,6", "5,inf")])
def test_strict_vintages(change):
    good = "sasdate,A,B\nTransform:,1,2\n1/1/2020,5,6\n2/1/2020,,7\n"
    assert len(datasets.parse_macro(good.encode(), "2020-03")) == 4
    with pytest.raises(ContractError):
        datasets.parse_macro(good.replace(*change).encode(), "2020-03")


def test_archives_and_sinks(tmp_path):
    path = str(tmp_path / "a.npz")
    manifest = arrays.save_arrays(path, {"x": np.arange(4.0).reshape(2, 2), "n": np.array([1, 2])})
    assert (arrays.load_arrays(path, manifest)["x"] == np.arange(4.0).reshape(2, 2)).all()
    with pytest.raises(ContractError):
        arrays.save_arrays(path, {"x": np.array([1.0])})  # exists
    with pytest.raises(ContractError):
        arrays.save_arrays(str(tmp_path / "b.npz"), {"x": np.array([np.nan])})
    with pytest.raises(ContractError):
        arrays.load_arrays(path, manifest | {"sha256": "0"})
    sinks.require_reasons({"a": None, "a_reason": "none yet", "b": [{"c": None, "reason": "r"}]})
    with pytest.raises(ContractError):
        sinks.require_reasons({"a": [{"c": None}]})
    sinks.write_lines(str(tmp_path / "l"), [{"a": 1, "b": None}], ["a", "b"])
    assert (tmp_path / "l").read_text() == '{"a": 1, "b": null}\n'
    with pytest.raises(ContractError):
        sinks.write_lines(str(tmp_path / "m"), [{"b": 1}], ["a", "b"])
