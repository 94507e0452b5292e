"""Windows fitted on their own rows: independence of the future, replay, fallbacks, controls, matching."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vintaloom.operators import numeric as N, windows as D
from vintaloom.operators.constraints import ContractError

S = D.Settings(starts=2, lambdas=(0.1, 1.0, 10.0))


def panel(n=80, seed=3, gaps=True):
    rng = np.random.default_rng(seed)
    p = pd.DataFrame(rng.normal(size=(n, 8)), index=range(n), columns=list("abcdefgh"))
    if gaps:
        p.loc[20, "a"] = np.nan
        p.loc[[30, 31, 32], "b"] = np.nan
    return p


GROUPS = {c: 1 for c in "abcdefg"} | {"h": 6}


def test_the_future_changes_nothing():
    p = panel()
    a = D.fit_state(p, 12, 48, 61, GROUPS, S)
    q = p.copy()
    q.loc[59:] = 1e6  # everything after the cutoff, base month 58
    b = D.fit_state(q, 12, 48, 61, GROUPS, S)
    for k in ("scores", "current", "next_p", "labels", "predictors"):
        assert np.array_equal(np.asarray(a[k]), np.asarray(b[k]))
    assert a["columns"] == list("abcdefg") and a["reasons"]["h"] == ["excluded_group"]
    assert max(a["fit"]) == 57 and len(a["fit"]) == 48  # condition months s - 2 of targets 12..59


def test_fill_select_and_scale():
    x = pd.DataFrame({"x": [100, 1, None, None, None, 9, 20.0], "flat": 1.0, "empty": np.nan, "gappy": [1.0, 2.0, None, None, None, 4, None]}, index=range(7))
    f = D.fit_features(x, range(1, 6), {}, D.Settings(missing_rate=0.6, variance=1.0))
    assert f["columns"] == ["x", "gappy"] and f["filled"][:, 0].tolist() == [1, 1, 1, 5, 9] and f["medians"][0] == 5 and f["mean"][0] == pytest.approx(3.4) and f["scale"][0] == pytest.approx(3.2)
    assert {k: v for k, v in f["reasons"].items() if v} == {"flat": ["constant"], "empty": ["no_observations", "missing_rate"]}
    with pytest.raises(ContractError):
        D.fit_features(x[["flat", "empty"]], range(1, 6), {}, S)


def test_states_transform_and_invert():
    p = panel()
    f = D.fit_features(p, range(10, 58), GROUPS, D.Settings(variance=1.0))
    assert np.allclose(D.transform_features(f, p * 0 + 7, [20, 40]), f["scores"][[10, 30]])  # fitted months replay
    assert np.allclose(D.inverse_features(f, f["scores"]), f["filled"])
    full = panel(gaps=False)
    g = D.fit_features(full, range(10, 58), GROUPS, D.Settings(variance=1.0))
    assert np.allclose(D.inverse_features(g, D.transform_features(g, full, [70])), full.loc[[70], g["columns"]])


def test_forecast_rules():
    rng = np.random.default_rng(417)
    x, y = rng.normal(size=(48, 4)), rng.normal(0.01, 0.03, size=(48, 3))
    labels = np.array([0] * 3 + [1] * 20 + [2] * 15 + [3] * 5 + [4] * 5)
    p = np.array([0.5, 0.1, 0.1, 0.1, 0.1, 0.1])
    rows = D.forecast(x, y, x[0], labels, p, S)
    final = {(r[0], r[1]): r[3] for r in rows if r[2] is None}
    cond = {(r[2], r[1]): r for r in rows if r[0] == "ridge" and r[2] is not None}
    assert final["ridge", 1] == pytest.approx(0.1 * sum(cond[k, 1][3] for k in range(1, 6)))  # the crisis half stays in cash
    assert [cond[k, 0][8] for k in range(1, 6)] == ["none", "none", "pooled", "pooled", "pooled"] and cond[5, 0][5:7] == (0, 48)
    naive = [r for r in rows if r[0] == "naive" and r[2] is None]
    assert naive[0][3] == pytest.approx(y[:3, 0].mean() / y[:3, 0].std(ddof=1)) and {r[2] for r in rows if r[0] == "bl"} == {0, None}
    means = D.forecast(x, y, x[0], labels, p, D.Settings(fallback="regime_mean", models=("ridge",)))
    assert [r[3] for r in means if r[2] == 3][0] == pytest.approx(y[labels == 3][:, 0].mean()) and [r[3] for r in means if r[2] == 5][0] == pytest.approx(y[:, 0].mean())
    fixed = D.forecast(x, y, x[0], labels, p, S, np.array([1.0, 2.0, 3.0]))
    assert {r[7] for r in fixed if r[0] == "ridge" and r[2] == 1} == {1.0, 2.0, 3.0}
    cash = D.forecast(x, y, x[0], labels, np.array([1.0, 0, 0, 0, 0, 0]), S)
    assert [r[3] for r in cash if r[0] == "ridge" and r[2] is None] == [0, 0, 0]


def test_probabilities_and_moves():
    move, skipped = D.transition_matrix(np.array([0, 1, 1, 2]), [0, 1, 3, 4], 3)
    assert skipped == 1 and move.tolist() == [[0, 1, 0], [0, 0, 1], [0, 0, 1]]
    p = D.regime_probabilities(np.array([1.0, 0.0]), np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert p.tolist() == [1.0, 0.0, 0.0]  # on the crisis center
    for bad in (np.array([0.5, 0.6]), np.array([np.nan, 1.0]), np.array([-0.5, 1.5])):
        with pytest.raises(ValueError):
            N.require_probabilities(bad)
    for bad in (np.array([[1.0, 2.0], [2.0, 1.0]]), np.array([[1.0, 0.1], [0.2, 1.0]])):
        with pytest.raises(ValueError):
            N.require_spd(bad)
    assert N.aligned({"b": 2, "a": 1}, ["a", "b"]).tolist() == [1, 2]
    with pytest.raises(ValueError):
        N.aligned({"a": 1}, ["a", "b"])


@pytest.fixture(scope="module")
def tables(spark):
    p = panel(70)
    rows = [(D._name(24000 + i), c, None if np.isnan(v) else float(v), GROUPS[c]) for i in p.index for c, v in p.loc[i].items()]
    rng = np.random.default_rng(1)
    ret = [(D._name(24000 + i), t, float(rng.normal(0.01, 0.05))) for i in range(3, 70) for t in "xyz"]
    months = spark.createDataFrame([(D._name(24000 + i),) for i in (60, 61, 62)], "month string")
    long = spark.createDataFrame(rows, "base_month string, series string, y double, grp int")
    returns = spark.createDataFrame(ret, "month string, ticker string, r double")
    return long, returns, months, D.window_states(long, D.outer_windows(months), S).persist()


def test_all_windows(spark, tables):
    long, returns, months, states = tables
    assert states.count() == 3 and D.require_intact(states).count() == 0
    assert D.require_intact(states.withColumn("skipped", F.col("skipped") + 1)).count() == 3
    short = returns.filter("ticker <> 'z' or month > '2001-01'")
    f = D.window_forecasts(states, short, S).filter("regime is null")
    z = {(r["decision_month"], r["status"], r["value"] is None) for r in f.filter("model = 'mvo' and ticker = 'z'").collect()}
    assert z == {(D._name(24060), "missing_history", True), (D._name(24061), "missing_history", True), (D._name(24062), "ok", False)}
    alone = D.fit_state(panel(70), 12, 48, 61, GROUPS, S)
    got = states.filter(F.col("window") == D._name(24061)).first()
    assert np.allclose(got["next_p"], alone["next_p"]) and list(got["labels"]) == alone["labels"].tolist()
    empty = D.window_states(long.filter("grp = 6"), D.outer_windows(months), S, strict=False).collect()
    assert {r["reason"] for r in empty} == {"no usable series in a window"} and {r["labels"] for r in empty} == {None}


def test_controls_keep_counts(tables):
    _, returns, _, states = tables
    c = D.with_labels(states, [0, 1]).collect()
    own = {r["decision_month"]: r for r in states.collect()}
    assert len(c) == 6
    for r in c:
        base = own[r["decision_month"]]
        assert sorted(r["labels"]) == sorted(base["labels"]) and r["predictors"] == base["predictors"] and sum(r["next_p"]) == pytest.approx(1)
    assert {tuple(r["labels"]) for r in c if r["decision_month"] == D._name(24061)} == {tuple(np.random.default_rng(s).permutation(np.array(own[D._name(24061)]["labels"]))) for s in (0, 1)}


def test_forward_validation_by_hand(tables):
    long, returns, months, _ = tables
    one = months.filter(F.col("month") == D._name(24061))
    errors = D.forward_errors(D.window_states(long, D.inner_windows(one), S), returns, S)
    got = {(r["ticker"], r["lambda"]): (r["mse"], r["months"]) for r in errors.collect()}
    assert {m for _, m in got.values()} == {24}
    r = {(x["month"], x["ticker"]): x["r"] for x in returns.collect()}
    e = []
    for k in range(24):
        rows, v = 23 + k, 12 + 23 + k + 1  # first target 61 - 49
        st = D.fit_state(panel(70), 12, rows, v, GROUPS, S)
        y = np.array([[r[D._name(24012 + i), "x"]] for i in range(rows)])
        pred = sum(st["next_p"][j] * fit[1][0] for j, _, _, _, fit in D.by_regime(st["predictors"], y, st["labels"], S, lambda u, w: D.ridge_predictions(u, w, st["current"], np.array(S.lambdas))))
        e.append((pred - r[D._name(24000 + v), "x"]) ** 2)
    assert got["x", 1.0][0] == pytest.approx(np.mean(e))
    assert D.forward_lambdas(errors).count() == 3 and D.forward_lambdas(errors, 25).count() == 0


def test_matching_and_selections(spark, tables):
    states = tables[3]
    m = D.match_states(states).collect()
    first = {r["regime"]: r["chain"] for r in m if r["status"] == "first"}
    assert len(m) == 18 and len(set(first.values())) == 6
    for r in m:
        if r["status"] == "matched":
            assert (r["regime"] == 0) == (r["previous_regime"] == 0)
    later = [r for r in m if r["decision_month"] == D._name(24061)]
    assert {r["chain"] for r in later} == set(first.values()) and all(r["chain"] == first[r["previous_regime"]] for r in later)
    s = spark.createDataFrame([("m", "x", 1.0, "2020-01-01 14:00:00"), ("m", "y", 1.0, "2020-01-01 13:59:59")], "decision_month string, ticker string, lambda double, selection_end_at string")
    d = spark.createDataFrame([("m", "2020-01-01 14:00:00")], "decision_month string, decision_at string")
    assert [r["ticker"] for r in D.usable_selections(s, d).collect()] == ["y"]


def test_full_sample(tables):
    out = D.full_sample(tables[0].filter("series <> 'b'"), S, 4).collect()
    elbow = [r["value"] for r in sorted((r for r in out if r["kind"] == "elbow"), key=lambda r: r["k"])]
    assert len(elbow) == 4 and all(a >= b for a, b in zip(elbow, elbow[1:])) and sum(r["kind"] == "month" for r in out) == 70
    assert sum(r["value"] for r in out if r["kind"] == "explained") >= 0.9
