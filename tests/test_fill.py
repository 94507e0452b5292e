import datetime as dt

import numpy as np
import pytest

from vintaloom.operators import chow_liu, fill

SCHEMA = "vintage_month string, base_month string, series string, value double, tcode int, macro_group int, assumed_available_at timestamp_ntz, value_kind string, value_reason string, filled_as string, _bin int"
T = dt.datetime(2020, 3, 1)


def macro(spark, rows):
    return spark.createDataFrame([("2020-01", m, s, v, 1, 2, T, "raw", why, "clash", 9) for m, s, v, why in rows], SCHEMA)


def test_cells_by_every_way_of_missing(spark):
    nan = float("nan")
    base = [(f"2019-{m:02d}", "A", float(m), "") for m in range(1, 7)]
    rows = base + [
        ("2019-07", "A", None, "provider_missing"), ("2019-08", "A", nan, None), ("2019-09", "A", -9999.0, " "), ("2019-10", "A", 0.0, "suppressed"),
        ("2019-11", "A", 7.0, "preliminary"), ("2019-12", "A", 8.0, "n/a"), ("2019-05", "B", 1e20, "n/a"),
    ]
    got = {(r["base_month"], r["series"], r["field"]): r["filled_as"] for r in fill.filled_cells(macro(spark, rows + rows[:3]), features(spark, [])).collect()}
    assert got == {
        ("2019-07", "A", "value"): "ffill", ("2019-08", "A", "value"): "ffill", ("2019-08", "A", "value_reason"): "reason", ("2019-09", "A", "value"): "median",
        ("2019-09", "A", "value_reason"): "reason", ("2019-10", "A", "value"): "median", ("2019-05", "B", "value"): "median", ("2019-05", "B", "value_reason"): "reason",
    }
    out = {(r["base_month"], r["series"]): r for r in fill.fill_macro(macro(spark, rows)).collect()}
    assert len(out) == len(rows)
    assert 1 <= out["2019-09", "A"]["filled_value"] <= 8 and out["2019-05", "B"]["filled_by"] == "scope_median" and out["2019-05", "B"]["filled_value"] == 4.0
    # the mark says how each figure was truly made: a carried one is that of the last two months
    for r in out.values():
        assert (r["filled_by"] is None) == (r["value_filled_as"] is None) and (r["filled_value"] is None) == (r["filled_by"] in (None, "none"))
        assert r["filled_by"] != "carried" or (r["value_filled_as"], r["filled_value"]) in {("ffill", 6.0), ("ffill", 8.0)}
    assert out["2019-08", "A"]["filled_reason"] in ("provider_missing", "suppressed") and out["2019-12", "A"]["filled_reason"] is None


def features(spark, rows):
    return spark.createDataFrame(rows, "window_id string, decision_month string, base_month string, series string, imputed double, observed_mask boolean, ffill_mask boolean, median_mask boolean")


def test_feature_masks_and_nulls(spark):
    rows = [("w", "2020-01", f"2019-{m:02d}", "A", float(m), True, False, False) for m in range(1, 4)]
    rows += [("w", "2020-01", "2019-04", "A", None, None, None, None), ("w", "2020-01", "2019-07", "A", float("nan"), False, None, None), (None, None, None, None, None, None, None, None)]
    rows += [("w", "2020-01", "2019-09", "A", 5.0, False, True, False)]
    out = {r["base_month"]: r for r in fill.fill_features(features(spark, rows + rows)).collect()}
    assert (out["2019-04"]["imputed_filled_as"], out["2019-04"]["filled_ffill"], out["2019-04"]["filled_median"]) == ("ffill", True, False)
    assert out["2019-07"]["imputed_filled_as"] == "median" and out[None]["imputed_filled_as"] == "median"
    assert out["2019-09"]["imputed_filled_as"] is None and out["2019-09"]["filled_ffill"] is True


def test_empty_tables(spark):
    assert fill.filled_cells(macro(spark, []), features(spark, [])).count() == 0


def test_posterior_matches_enumeration():
    rng = np.random.default_rng(1)
    cards, joint = (2, 3, 2), None
    ab, bc = rng.random((2, 3)), rng.random((3, 2))
    ab /= ab.sum()
    bc = bc / bc.sum(1, keepdims=True) * ab.sum(0)[:, None]
    tree = chow_liu.ChowLiuTree(("a", "b", "c"), cards, {(0, 1): ab, (1, 2): bc}, (ab.sum(1), ab.sum(0), bc.sum(0)))
    joint = ab[:, :, None] * (bc / bc.sum(1, keepdims=True))[None]
    p = tree.posterior(np.array([[-1, -1, 1], [1, -1, -1], [-1, -1, -1]]), 1)
    want = [joint[:, :, 1].sum(0), joint[1].sum(1), joint.sum((0, 2))]
    assert np.allclose(p, [w / w.sum() for w in want])


def test_tree_finds_dependencies(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, 2000)
    b = np.where(rng.random(2000) < 0.9, a, rng.integers(0, 3, 2000))
    c = np.where(rng.random(2000) < 0.9, b, rng.integers(0, 3, 2000))
    df = spark.createDataFrame([(int(x), int(y), int(z) if i % 7 else None) for i, (x, y, z) in enumerate(zip(a, b, c))], "a int, b int, c int")
    tree = chow_liu.fit_tree(df, ["a", "b", "c"], [3, 3, 3])
    assert set(tree.joints) == {(0, 1), (1, 2)}
    filled = chow_liu.posterior_modes(df.filter("c is null"), tree, ["c"]).collect()
    assert np.mean([r["c_mode"] == r["b"] for r in filled]) == 1.0


def test_held_out_values_are_recovered_better_than_by_the_series_median(spark):
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.standard_normal(240)) * 5 + 100
    months = [f"{2000 + i // 12}-{i % 12 + 1:02d}" for i in range(240)]
    hide = set(range(7, 240, 9))
    df = macro(spark, [(m, "A", None if i in hide else float(v), "provider_missing" if i in hide else "") for i, (m, v) in enumerate(zip(months, walk))])
    got = {r["base_month"]: r["filled_value"] for r in fill.fill_macro(df).filter("value_filled_as is not null").collect()}
    err = np.median([abs(got[months[i]] - walk[i]) for i in hide])
    assert err < 0.5 * np.median([abs(np.median(walk) - walk[i]) for i in hide])


@pytest.mark.parametrize("reason,observed", [("Revised", True), ("preliminary", True), ("Not collected", False), ("data withheld", False), (None, True), ("N/A", True)])
def test_reasons(spark, reason, observed):
    df = macro(spark, [("2019-01", "A", 1.0, reason)])
    assert df.select(fill.usable(df["value"], df["value_reason"])).first()[0] is observed


def test_a_series_without_figures_takes_its_other_vintages(spark):
    rows = [("v1", f"2019-{m:02d}", "A", float(m), 1, 2, T, "raw", "", "", 0) for m in range(1, 6)] + [("v2", f"2019-{m:02d}", "A", None, 1, 2, T, "raw", "", "", 0) for m in range(1, 6)]
    out = {r["vintage_month"]: r for r in fill.fill_macro(spark.createDataFrame(rows, SCHEMA)).filter("value_filled_as is not null").collect()}
    assert (out["v2"]["filled_by"], out["v2"]["filled_value"]) == ("entity_median", 3.0)
    none = fill.fill_macro(spark.createDataFrame(rows[5:], SCHEMA)).collect()
    assert {(r["filled_by"], r["filled_value"]) for r in none} == {("none", None)}


def test_reasons_beyond_the_dictionary_are_decoded(spark, monkeypatch):
    common = [(f"{2000 + i // 12}-{i % 12 + 1:02d}", s, None if i % 3 == 0 else float(i), f"withheld by {s}" if i % 3 == 0 and i != 60 else "") for s in "ABCD" for i in range(90)]
    monkeypatch.setattr(fill, "dictionary", lambda df, column, size=32, real=fill.dictionary: real(df, column, 1))
    out = {r["series"]: r["filled_reason"] for r in fill.fill_macro(macro(spark, common)).filter("reason_filled_as is not null").collect()}
    assert len(out) == 4 and all(v is not None for v in out.values())
    assert sum(v == f"withheld by {k}".lower() for k, v in out.items()) >= 3  # the state of all rare reasons is the most probable one


def test_counted_tables_equal_a_plain_count(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(int(x) if x >= 0 else None for x in r) for r in rng.integers(-1, 3, (500, 3))]
    df = spark.createDataFrame(rows, "a int, b int, c int").repartition(5)
    tree = chow_liu.fit_tree(df, ["a", "b", "c"], [3, 3, 3], smoothing=1e-9)
    for (i, j), t in tree.joints.items():
        want = np.zeros((3, 3))
        for r in rows:
            if r[i] is not None and r[j] is not None:
                want[r[i], r[j]] += 1
        assert np.allclose(t, want / want.sum())
