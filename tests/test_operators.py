"""Golden values and brute-force checks of the relational, portfolio and numeric operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintaloom.functions.vectors import combine_probabilities, cosine_distance, distance_probabilities, unit
from vintaloom.operators import constraints as C, numeric as N, portfolio as P, regimes as R, statistics as S, timing as T, transforms as X

MONTHS = ["2020-01", "2020-02", "2020-03", "2020-04", "2020-05", "2020-06", "2020-07"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


@pytest.mark.parametrize("code,want", [
    (1, [1, 2, 8, 32]), (2, [None, 1, 6, 24]), (3, [None, None, 5, 18]), (4, [0, math.log(2), 3 * math.log(2), 5 * math.log(2)]),
    (5, [None, math.log(2), 2 * math.log(2), 2 * math.log(2)]), (6, [None, None, math.log(2), 0]), (7, [None, None, 2, 0]), (9, [None] * 4),
])
def test_codes(spark, code, want):
    df = spark.createDataFrame([("a", m, float(v), code) for m, v in zip(MONTHS, [1, 2, 8, 32])], "s string, m string, v double, c int")
    got = [r["y"] for r in X.transform_series(df, ["s"], "m", "v", "c").orderBy("m").collect()]
    assert all((g is None and w is None) or g == pytest.approx(w) for g, w in zip(got, want))


def test_gap_is_inserted_before_differencing(spark):
    df = spark.createDataFrame([("a", "2020-01", 1.0, 2), ("a", "2020-03", 4.0, 2), ("a", "2020-04", 8.0, 2)], "s string, m string, v double, c int")
    assert [r["y"] for r in X.transform_series(df, ["s"], "m", "v", "c").orderBy("m").collect()] == [None, None, None, 4.0]


def test_bounded_fill(spark):
    df = spark.createDataFrame([("a", m, v) for m, v in zip(MONTHS, [100.0, 1.0, None, float("nan"), None, 9.0, 20.0])], "s string, m string, v double")
    got = X.impute_bounded(df, ["s"], "m", "v", 2, "2020-02", "2020-06").orderBy("m").collect()
    assert [r["imputed"] for r in got][1:6] == [1, 1, 1, 5, 9]
    assert (sum(r["observed"] for r in got[1:6]), sum(r["ffill"] for r in got[1:6]), sum(r["median_fill"] for r in got[1:6])) == (2, 2, 1)


def test_probabilities(spark):
    assert one(spark, distance_probabilities(arr(1, 2, 3))) == pytest.approx([5 / 12, 1 / 3, 1 / 4])
    assert one(spark, distance_probabilities(arr(0, 1, 1, 1, 1))) == pytest.approx([0.25] + [0.1875] * 4)
    assert one(spark, distance_probabilities(arr(0, 0))) == [0.5, 0.5]
    for p0, want in ((0.5, [0.375, 0.375, 0.25]), (0.75, [6 / 11, 3 / 11, 2 / 11]), (0.0, [0, 0.6, 0.4]), (1.0, [1, 0, 0])):
        assert one(spark, combine_probabilities(F.lit(p0), arr(0.6, 0.4))) == pytest.approx(want)
    rows = [[one(spark, cosine_distance(unit(arr(*a)), unit(arr(*b)))) for b in ((0, 0), (1, 0))] for a in ((0, 0), (1, 0), (-1, 0))]
    assert rows == [[0, 1], [1, 0], [1, 2]]
    assert one(spark, unit(arr(3e300, 4e300))) == pytest.approx([0.6, 0.8])


def test_transitions_departures_and_next(spark):
    lab = spark.createDataFrame(list(zip(["2000-01", "2000-02", "2000-03", "2000-04"], [0, 1, 1, 2])), "month string, label int")
    m = {(r["src"], r["dst"]): r for r in R.transitions(lab, 3).collect()}
    assert [[m[i, j]["p"] for j in range(3)] for i in range(3)] == [[0, 1, 0], [0, 0.5, 0.5], [0, 0, 1]] and m[2, 2]["p_literal"] == 0
    gap = R.transitions(lab.filter("month <> '2000-02'"), 3).collect()
    assert gap[0]["skipped"] == 1 and sum(r["n"] for r in gap) == 1
    mat = spark.createDataFrame([(i, j, float(p)) for i, row in enumerate([[0.5, 0.3, 0.2], [0, 1, 0], [0.1, 0.3, 0.6]]) for j, p in enumerate(row)], "src int, dst int, p double")
    dep = {(r["src"], r["dst"]): (r["p"], r["absorbing"]) for r in R.departures(mat).collect()}
    assert dep[0, 1][0] == pytest.approx(0.6) and dep[1, 0] == (0.0, True) and dep[2, 1][0] == pytest.approx(0.75)
    mat = spark.createDataFrame([(i, j, float(p)) for i, row in enumerate([[0.5, 0.5, 0.0], [0.0, 0.4, 0.6], [1.0, 0.0, 0.0]]) for j, p in enumerate(row)], "src int, dst int, p double")
    now = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.5), (1, 2, 0.3)], "id int, label int, p double")
    assert [r["p"] for r in R.next_probabilities(now, mat).orderBy("label").collect()] == pytest.approx([0.4, 0.3, 0.3])


def test_minmax_and_islands(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", 10.0), ("b", 7.0), ("b", 7.0), ("c", None), ("c", 0.0), ("c", 2.0)], "k string, v double")
    got = sorted(((r["k"], r["v"], r["scaled"]) for r in R.row_minmax(df, "k", "v").collect()), key=repr)
    assert got == sorted([("a", 2.0, 0.0), ("a", 4.0, 0.25), ("a", 10.0, 1.0), ("b", 7.0, 0.0), ("b", 7.0, 0.0), ("c", None, None), ("c", 0.0, 0.0), ("c", 2.0, 1.0)], key=repr)
    f = spark.createDataFrame(list(zip(MONTHS, [False, True, True, False, True, False, False])), "month string, f boolean")
    assert [(r[0], r[1], r[2]) for r in R.islands(f, "f").orderBy("first_month").collect()] == [("2020-02", "2020-03", 2), ("2020-05", "2020-05", 1)]


@pytest.mark.parametrize("sizing,size,want", [("lo", 2, {"a": 0.75, "b": 0.25}), ("lns", 2, {"a": 0.5, "b": 1 / 6, "c": -1 / 3}), ("los", 2, {"a": 0.6, "c": -0.4})])
def test_allocation(spark, sizing, size, want):
    s = spark.createDataFrame([("m", "a", 3.0), ("m", "b", 1.0), ("m", "c", -2.0), ("m", "d", None), ("m", "e", 0.0)], "month string, ticker string, score double")
    assert {r["ticker"]: r["weight"] for r in P.allocate(s, size, sizing).collect()} == pytest.approx(want)
    assert P.allocate(s.filter("score < 0"), 2, "lo").count() == 0


def test_account_costs_and_drift(spark):
    w = spark.createDataFrame([("s", "m1", "A", 0.6), ("s", "m1", "B", -0.4), ("s", "m2", "A", 0.6), ("s", "m2", "B", -0.4)], "strategy string, month string, ticker string, weight double")
    r = spark.createDataFrame([("m1", "A", 0.10), ("m1", "B", -0.05), ("m2", "A", 0.0), ("m2", "B", 0.0)], "month string, ticker string, r double")
    a, b = P.account(w, r, ["strategy"]).orderBy("month").collect()
    assert (a["net"], a["wealth"], a["turnover"]) == pytest.approx((0.08, 1.08, 1.0)) and b["turnover"] == pytest.approx(abs(0.6 - 0.66 / 1.08) + abs(-0.4 + 0.38 / 1.08))
    z = P.account_without_costs(w, r, ["strategy"]).orderBy("month").collect()
    assert [x["turnover"] for x in z] == pytest.approx([a["turnover"], b["turnover"]])
    w = spark.createDataFrame([("s", "m", "A", 1.5), ("s", "m", "B", -0.5)], "strategy string, month string, ticker string, weight double")
    r = spark.createDataFrame([("m", "A", 0.1), ("m", "B", -0.1)], "month string, ticker string, r double")
    c = P.account(w, r, ["strategy"], cost_bps=10, borrow=0.02, days=33).first()
    assert c["cost"] == pytest.approx(0.002 + 0.5 * 0.02 * 33 / 365)


def test_performance(spark):
    df = spark.createDataFrame([("s", "2020-01", -0.10), ("s", "2020-02", 0.05), ("one", "2020-01", 0.1), ("flat", "2020-01", 0.01), ("flat", "2020-02", 0.01)], "k string, m string, r double")
    p = {r["k"]: r for r in P.performance(df, ["k"], "m", "r").collect()}
    s = p["s"]
    assert (s["maxdd"], s["avgdd"], s["cagr"]) == pytest.approx((-0.1, -0.0775, 0.945**6 - 1))
    assert p["one"]["sharpe"] is None and p["one"]["sharpe_reason"] == "fewer_than_two_months" and p["flat"]["sharpe_reason"] == "zero_excess_return_standard_deviation"
    q = spark.createDataFrame([("s", f"2020-0{i}", r) for i, r in enumerate((-0.09, 0.11, 0.11), 1)], "k string, m string, r double")
    assert P.performance(q, ["k"], "m", "r", rf=0.01).first()["sortino"] == pytest.approx((0.1 / 3) / math.sqrt(0.01 / 3) * math.sqrt(12))


def test_statistics(spark):
    h = spark.createDataFrame([("f", "a", 0.04), ("f", "b", 0.01), ("f", "c", None), ("f", "d", 0.03)], "f string, k string, p double")
    got = {r["k"]: r["p_holm"] for r in S.holm(h, ["f"], "p", "k").collect()}
    assert got["c"] is None and [got[k] for k in "abd"] == pytest.approx([0.09, 0.04, 0.09])
    d = spark.createDataFrame([("x", v, 0.0) for v in (2.0, 2.0, 4.0, 5.0)] + [("y", 1.0, 0.0)] * 2, "k string, a double, b double")
    p = {r["k"]: r for r in S.paired_statistics(d, ["k"]).withColumns({"pn": S.normal_tail(F.col("z")), "pt": S.student_tail(F.col("t"), F.col("n") - 1)}).collect()}
    assert p["x"]["t"] == pytest.approx(3.25 / 0.75) and p["x"]["pn"] == pytest.approx(math.erfc(math.sqrt(2))) and p["y"]["t"] is None and p["y"]["reason"] == "constant_difference"
    assert p["x"]["pt"] == pytest.approx(0.01135, abs=2e-4)  # upper tail of t(3) at 4.3333
    b = S.block_indices(spark, 10, 4, 3).groupBy("draw").agg(F.count("*").alias("n"), F.max("idx").alias("m")).collect()
    assert all(r["n"] == 10 and r["m"] < 10 for r in b)


def test_timing(spark):
    v = spark.createDataFrame([("2002-11",), ("2002-12",), ("2003-01",)], "vintage_month string")
    m = spark.createDataFrame([("2003-02",), ("2002-01",)], "month string")
    led = {r["month"]: r for r in T.decision_ledger(m, v, T.exchange_sessions(spark, 1990, 2004)).withColumn("at", F.col("decision_at").cast("string")).collect()}
    r = led["2003-02"]
    assert (r["vintage"], r["cutoff"], r["n_rows"], r["training_rows"][0]["target_month"], r["training_rows"][-1]["target_month"]) == ("2002-12", "2002-11", 48, "1999-01", "2002-12")
    assert r["targets_ended"] and r["bases_known"] and r["vintage_available"] and led["2002-01"]["vintage"] is None
    assert r["at"] == "2003-02-03 14:00:00" and r["session"] == "2003-02-03" and r["training_rows"][-1]["target_end_at"] < r["decision_at"]
    wrong = T.decision_ledger(m, v, T.exchange_sessions(spark, 1990, 2004).filter("session < '2003-01-01' or session >= '2003-02-01'")).filter("month = '2003-02'").first()
    assert not wrong["targets_ended"]  # the last target's end isn't known
    fixed = T.decision_ledger(m, v, T.exchange_sessions(spark, 1990, 2004), fixed="2003-01").filter("month = '2003-02'").first()
    assert fixed["vintage"] == "2003-01" and fixed["vintage_available"] is None
    folds = T.forward_folds(m, "month").filter("month = '2003-02'").orderBy("fold").collect()
    # 24 folds of 23 to 46 rows; the last is tried on the month two before the decision, whose return has ended
    assert [f["rows"] for f in folds] == list(range(23, 47)) and {f["first_target"] for f in folds} == {"1999-01"}
    assert (folds[0]["validation_month"], folds[-1]["last_target"], folds[-1]["validation_month"]) == ("2001-01", "2002-10", "2002-12")
    assert one(spark, T.decision_time(F.lit("2003-02-03")).cast("string")) == "2003-02-03 14:00:00"
    d = spark.createDataFrame([(dt.datetime(2023, 3, 1, 21), dt.datetime(2023, 4, 3, 20))], "a timestamp_ntz, b timestamp_ntz")
    assert d.select(T.holding_days(F.col("a"), F.col("b"))).first()[0] == 33


@pytest.mark.parametrize("month,first", [("2003-02", "2003-02-03"), ("2023-01", "2023-01-03"), ("2001-09", "2001-09-04"), ("2012-04", "2012-04-02"), ("2022-01", "2022-01-03")])
def test_first_sessions(spark, month, first):
    s = T.first_sessions(T.exchange_sessions(spark, int(month[:4]), int(month[:4])))
    assert s.filter(F.col("month") == month).first()["session"] == first


def test_constraints(spark):
    a = spark.createDataFrame([(1, "p", 1.0), (2, "p", 2.0)], "k int, part string, v double")
    assert C.checked_join(a, a, ["k"], "part").columns == ["k", "part", "v", "part_right", "v_right"]
    for bad in (a.filter("k = 1"), a.union(a), a.withColumn("part", F.lit("q"))):
        with pytest.raises(C.ContractError):
            C.checked_join(a, bad, ["k"], "part")
    with pytest.raises(C.ContractError):
        C.require_unique(a.union(spark.createDataFrame([(None, "p", 0.0)], a.schema)), ["k"])
    assert C.missing_cells(spark.createDataFrame([(1, "x"), (2, "y")], "r int, c string"), "r", "c").count() == 2
    o = C.overlay(a, spark.createDataFrame([(2, "n", 9.0), (3, "n", 9.0)], a.schema), ["k"])
    assert sorted((r["k"], r["v"]) for r in o.collect()) == [(1, 1.0), (2, 9.0), (3, 9.0)]
    assert C.differences(a, a.filter("k = 1")).count() == 1


def test_ridge_path_against_refits():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(8, 3)), rng.normal(size=8)
    lam = np.array([1e-3, 0.5, 10.0])
    coef, icpt, mse = N.ridge_path(x, y, lam)
    for k, v in enumerate(lam):
        err = []
        for i in range(8):
            m = np.arange(8) != i
            xm, ym = x[m].mean(0), y[m].mean()
            b = np.linalg.solve((x[m] - xm).T @ (x[m] - xm) + v * np.eye(3), (x[m] - xm).T @ (y[m] - ym))
            err.append((y[i] - ym - (x[i] - xm) @ b) ** 2)
        assert mse[k] == pytest.approx(np.mean(err))
    assert N.choose_lambda(np.array([1.0, 2.0, 3.0]), np.array([0.5, 0.1, 0.1 * (1 + 1e-13)])) == 2
    assert np.isfinite(N.ridge_path(np.eye(4), np.arange(4.0), np.array([1e-14]))[2]).all()


def test_components_partition_and_matching():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(45, 4)), rng.normal(18, 0.1, size=(3, 4))])
    labels, centers = N.two_stage(x)
    assert set(np.flatnonzero(labels == 0)) == {45, 46, 47} and set(labels) == set(range(6)) and np.allclose(np.linalg.norm(centers[1:], axis=1), 1)
    s, v, ratio = N.principal_components(x, 0.95)
    assert ratio.sum() >= 0.95 and (ratio[:-1].sum() < 0.95) and (v[np.arange(len(v)), np.abs(v).argmax(1)] > 0).all() and np.allclose(s, (x - x.mean(0)) @ v.T)
    old = np.array([[0.0, 0.0], [5.0, 2.0]])
    assert N.match_centers(old, old[::-1]) == ((1, 0), 0.0)
    mu, resp = N.gaussian_mixture(x, (labels > 0).astype(int))
    assert np.allclose(resp.sum(1), 1) and np.allclose(mu[0], x[45:].mean(0), atol=0.1)
    mean, cov = np.array([0.1, 0.2]), np.array([[0.04, 0.01], [0.01, 0.09]])
    post = N.black_litterman(mean, cov, np.array([0.3]), np.array([[1.0, 0.0]]), np.array([[0.02]]))
    t = 0.05 * cov
    want = np.linalg.inv(np.linalg.inv(t) + np.outer([1, 0], [1, 0]) / 0.02) @ (np.linalg.inv(t) @ mean + np.array([1, 0]) * 0.3 / 0.02)
    assert np.allclose(post, want) and (N.black_litterman(mean, cov, np.zeros(0), np.zeros((0, 2)), np.zeros((0, 0))) == mean).all()
