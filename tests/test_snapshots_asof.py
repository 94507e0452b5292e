import datetime as dt
import random

from pyspark.sql import functions as F

from vintaloom.operators import asof, snapshots


def test_changes(spark):
    rows = [
        ("v1", "m1", "A", 1.0, True), ("v1", "m1", "A", 1.0, True), ("v1", "m2", "A", 2.0, True), ("v1", "m3", "A", 3.0, True), ("v1", "m4", "A", None, False), ("v1", "m5", "A", 5.0, True), ("v1", None, "A", 1.0, True),
        ("v2", "m1", "A", 1.0 + 1e-12, True), ("v2", "m2", "A", 2.1, True), ("v2", "m4", "A", 4.0, True), ("v2", "m5", "A", None, False), ("v2", "m6", "A", 0.0, True), ("v2", None, "A", 2.0, True),
        ("v4", "m6", "A", -0.0, True), ("v4", None, "A", 2.0, True), (None, "m1", "A", 9.0, True),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "v string, m string, s string, x double, ok boolean, n int")
    out = {(r["v"], r["m"]): r["change_kind"] for r in snapshots.snapshot_changes(df, snapshot="v", keys=["m", "s"], value="x", state="ok").collect()}
    assert out == {
        ("v2", "m2"): "changed", ("v2", "m3"): "removed", ("v2", "m4"): "changed", ("v2", "m5"): "changed", ("v2", "m6"): "added", ("v2", None): "changed",
        ("v4", "m1"): "removed", ("v4", "m2"): "removed", ("v4", "m4"): "removed", ("v4", "m5"): "removed",
    }
    assert snapshots.snapshot_changes(df.limit(0), snapshot="v", keys=["m", "s"], value="x", state="ok").count() == 0


def test_as_of_against_brute_force_with_and_without_shards(spark):
    rnd = random.Random(5)
    t0 = dt.datetime(2020, 1, 1)
    at = lambda: t0 + dt.timedelta(days=rnd.randrange(40))
    events = [(i, rnd.choice(["hot"] * 6 + ["b", "c", None]), rnd.choice([at(), at(), at(), None]), "x") for i in range(300)]
    versions = [(rnd.choice(["hot"] * 6 + ["b", "d", None]), rnd.choice([at(), at(), None]), i) for i in range(200)]
    e = spark.createDataFrame(events, "id int, k string, t timestamp_ntz, known string")
    v = spark.createDataFrame(versions, "k string, at timestamp_ntz, ver int")
    want = {}
    for i, k, t, _ in events:
        seen = [(a, n) for kk, a, n in versions if kk == k and k and a and t and a < t]
        want[i] = max(seen)[1] if seen else None
    for hot, days in ((10**9, 10**4), (10**9, 7), (5, 7), (40, 10**4)):
        got = asof.attach_as_of(e, v, entity="k", event_time="t", version_entity="k", version_time="at", rank=F.struct("at", "ver"), payload="known", hot_rows=hot, shard_days=days)
        assert {r["id"]: r["known"] and r["known"]["ver"] for r in got.collect()} == want


def test_account_knowledge_defaults(spark):
    t = dt.datetime(2020, 5, 1)
    a = spark.createDataFrame([("r", "m", "s", "X", t)] * 2 + [("r", "m2", "s", None, None)], "run_id string, holding_month string, strategy_id string, signal_series string, decision_at timestamp_ntz")
    s = spark.createDataFrame([(1, "r", t), (2, "r", dt.datetime(2020, 4, 1)), (3, "r", dt.datetime(2020, 4, 1)), (4, "r", None)], "selection_id long, run_id string, selection_end_at timestamp_ntz")
    m = spark.createDataFrame([("X", "2020-03", dt.datetime(2020, 4, 30)), ("X", "2020-02", dt.datetime(2020, 4, 30, 23)), ("X", "2020-04", t)], "series string, vintage_month string, assumed_available_at timestamp_ntz")
    got = {r["holding_month"]: (r["vintage_month"], r["selection_id"]) for r in asof.account_knowledge(a, s, m).collect()}
    assert got == {"m": ("2020-03", 3), "m2": ("", -1)}
    assert asof.account_knowledge(a.limit(0), s.limit(0), m.limit(0)).count() == 0
