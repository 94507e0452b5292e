import datetime as dt
import json

import numpy as np

from vintaloom.operators import drift, spikes


def prices(spark, rows):
    return spark.createDataFrame([(*r, True, "clash") for r in rows], "session string, ticker string, open double, high double, low double, close double, adj_close double, volume double, retrieved_at timestamp_ntz, finalized boolean, change string")


def quiet(n=120, seed=1):
    rng = np.random.default_rng(seed)
    p = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    days = [(dt.date(2020, 1, 1) + dt.timedelta(i)).isoformat() for i in range(n)]
    return [[d, "A", x, x * 1.005, x * 0.995, x, x, float(v), dt.datetime(2021, 1, 1)] for d, x, v in zip(days, map(float, p), rng.integers(1000, 2000, n))]


def test_planted_readings(spark):
    r = quiet()
    r[10][6] *= 2  # back the next session
    r[20][6] *= 0.5
    r[21][6] *= 0.5  # back after two
    for i in range(60, 120):
        for k in (2, 3, 4, 5, 6):
            r[i][k] *= 1.6  # a move that holds
    r[30][7] = -5.0
    r[35][7] = 1e6
    r[40][3] = r[40][5] * 1.4
    r[45][4] = 0.0
    r[47][6], r[48][7] = None, float("nan")
    for i in range(71, 77):
        r[i][6] = r[70][6]
    for i in range(90, 94):
        r[i][6] = r[89][6]  # five in a row are too few
    late = list(r[50])
    late[6], late[8] = -1.0, dt.datetime(2020, 6, 1)  # an earlier delivery doesn't count
    got = {x["session"]: x["reasons"] for x in spikes.implausible_readings(prices(spark, [tuple(x) for x in r + [late, r[5]]])).collect()}
    day = lambda i: r[i][0]
    want = {10: "spike", 20: "spike", 21: "spike", 30: "impossible", 35: "volume", 40: "range", 45: "impossible", **{i: "stuck" for i in range(71, 77)}}
    assert {k: v[0] for k, v in got.items()} == {day(i): w for i, w in want.items()}


def test_no_prices(spark):
    assert spikes.implausible_readings(prices(spark, [])).count() == 0
    assert spikes.implausible_readings(prices(spark, [(None,) * 9, ("2020-01-01", None, None, None, None, None, None, None, None)])).count() == 0


def lines(spark, files):
    rows = [(f, m, dt.datetime(2020, 1, 1), i + 1, text, 0) for f, m, body in files for i, text in enumerate(body)]
    return spark.createDataFrame(rows, "feed_id string, vintage_month string, received_at timestamp_ntz, line_no int, line string, cell int")


A = ["date,X,Y,Z", "Transform:,1,2,3", "Group:,4,5,6", "1/1/2020,1.5,2000.5,7", "", "2/1/2020,2.5,2001.5,NA", "3/1/2020,3.5,2002.5,9"]
B = ['"sasdate";"W";"x2";"Z"', '"transform";"9.0";"1.0";" 3"', '"group";"1";"4";"7"', '"2/1/2020";"5";"2,5";"8 mn"', ";;;", '"3/1/2020";"6";"3,5";"9 mn"', '"4/1/2020";"7";"4,5";"10 mn"']


def test_changes_and_values(spark):
    df = lines(spark, [("f", "2020-01", A), ("f", "2020-02", B), ("g", "2020-01", A)])
    got = {(r["field"], r["change_kind"], r["former_field"]) for r in drift.schema_changes(df.union(df)).collect()}
    assert got == {("sasdate", "renamed", "date"), ("x2", "renamed", "X"), ("x2", "retyped", ""), ("Z", "retyped", ""), ("Z", "group", ""), ("Y", "removed", ""), ("W", "added", "")}
    t = {(r["vintage_month"], r["series"], r["base_month"]): (r["value"], r["tcode"], r["macro_group"], r["rescued"]) for r in drift.ingest(df.filter("feed_id = 'f'")).collect()}
    assert t["2020-02", "Z", "2020-04"] == (10.0, 3, 7, None) and t["2020-02", "x2", "2020-02"] == (2.5, 1, 4, None) and t["2020-01", "Z", "2020-02"] == (None, 3, 6, None)
    kept = drift.replay(drift.enforce(df.filter("feed_id = 'f'")), approved=["x2"]).filter("rescued is not null").collect()
    assert {r["series"] for r in kept} == {"Z"} and any('"cell":"8 mn"' in r["rescued"] for r in kept)  # rows come in any order


def test_order_quoting_and_nulls_are_no_change(spark):
    swapped = ["date\tZ\tX\tY", "transform\t3\t1.0\t2", "group\t6\t4\t5", '2/1/2020\t\t2.5\t"2,001.5"', "3/1/2020\t9\t3.5\t2002.5", "4/1/2020\t9\t4.5\t2003.5"]
    df = lines(spark, [("f", "2020-01", A), ("f", "2020-02", swapped)])
    assert drift.schema_changes(df.union(spark.createDataFrame([(None, None, None, None, None, None)], df.schema))).collect() == []
    assert drift.schema_changes(df.limit(0)).collect() == [] and drift.ingest(df.limit(0)).collect() == []


def test_changes_read_the_replayed_figures(spark, monkeypatch):
    old = ["date,X,Y", "1/1/2020,5.e3,1", "2/1/2020,6.e3,2", "3/1/2020,7.e3,3"]
    new = ["date,X2,Y", "1/1/2020,5000,1 mn", "2/1/2020,6000,2 mn", "3/1/2020,7000,3 mn"]
    steps = []
    replay = drift.replay
    monkeypatch.setattr(drift, "replay", lambda table, *a: steps.append(table) or replay(table, *a))
    got = {(r["field"], r["change_kind"], r["former_field"]) for r in drift.schema_changes(lines(spark, [("f", "2020-01", old), ("f", "2020-02", new)])).collect()}
    assert got == {("X2", "renamed", "X"), ("Y", "retyped", "")}
    assert steps[0].filter("rescued is not null").count() == 3


def test_cells_without_a_name_are_rescued(spark):
    body = ["date,X,,X", "1/1/2020,1,2,3,4", "2/1/2020,5,,,"]
    t = drift.ingest(lines(spark, [("f", "2020-01", body)])).collect()
    assert {(r["series"], r["base_month"], r["value"]) for r in t} == {("X", "2020-01", 1.0), ("X", "2020-02", 5.0), ("#3", "2020-01", None), ("#4", "2020-01", None), ("#5", "2020-01", None)}
    assert {r["series"]: json.loads(r["rescued"])["cell"] for r in t if r["rescued"]} == {"#3": "2", "#4": "3", "#5": "4"}


def test_one_series_has_one_name_in_the_table(spark):
    c = ['date,W2,x2,Z', "Transform:,9,1,3", "3/1/2020,6,3.5,9", "4/1/2020,7,4.5,10", "5/1/2020,8,5.5,11 mn", "6/1/2020,9 mn,6.5,12"]
    df = lines(spark, [("f", "2020-01", A), ("f", "2020-02", B), ("f", "2020-03", c)])
    rows = drift.ingest(df).collect()
    assert {(r["field"], r["series"]) for r in rows} == {("X", "x2"), ("x2", "x2"), ("Y", "Y"), ("Z", "Z"), ("W", "W2"), ("W2", "W2")}
    # W has no code from 1 to 7 in any file: what can't be cast stays in rescued
    left = {(r["series"], r["base_month"], json.loads(r["rescued"])["cell"]) for r in rows if r["rescued"]}
    assert left == {("W2", "2020-06", "9 mn")}
    assert {(r["series"], r["value"]) for r in rows if r["base_month"] == "2020-05"} == {("W2", 8.0), ("x2", 5.5), ("Z", 11.0)}


def test_file_without_header_is_rescued(spark):
    body = ["1/1/2020,1,2 mn", "2/1/2020,3,"]
    t = drift.ingest(lines(spark, [("f", "2020-01", body)])).collect()
    assert {(r["series"], r["base_month"], r["value"], json.loads(r["rescued"])["cell"]) for r in t} == {("#2", "2020-01", None, "1"), ("#3", "2020-01", None, "2 mn"), ("#2", "2020-02", None, "3")}
    got = drift.cell_balance(lines(spark, [("f", "2020-01", body), ("g", "2020-01", A)])).collect()
    assert {(r["feed_id"], r["figures"], r["typed"], r["rescued"]) for r in got} == {("f", 3, 0, 3), ("g", 8, 8, 0)}


def test_quoted_cells(spark):
    rows = [('a,"b,c",d', ["a", "b,c", "d"]), (',"x ""y""", z', ["", 'x ""y', "z"]), ('"open,1', ["open", "1"]), ("a,,", ["a", "", ""]), ("\t\t\"1,5\"", ["\t\t\"1", "5"])]
    df = spark.createDataFrame([(r[0],) for r in rows], "line string")
    got = [list(r[0]) for r in df.select(drift.split_cells(df["line"], drift.F.lit(","))).collect()]
    assert got[0] == rows[0][1] and got[2:4] == [r[1] for r in rows[2:4]] and got[1][0] == "" and got[1][2] == "z"
    tab = spark.createDataFrame([('\t\t"1,5"',)], "line string")
    assert list(tab.select(drift.split_cells(tab["line"], drift.F.lit("\t"))).first()[0]) == ["", "", "1,5"]


def test_a_weekday_with_its_own_behaviour_has_its_own_fences(spark):
    r = quiet(2100, 4)
    rng = np.random.default_rng(8)
    wild = [i for i, x in enumerate(r) if dt.date.fromisoformat(x[0]).weekday() == 0]
    for i in wild:  # Mondays jump and come back each week
        r[i][6] *= float(np.exp(rng.normal(0, 0.12)))
    tuesday = next(i for i in range(1500, 1600) if dt.date.fromisoformat(r[i][0]).weekday() == 3)
    r[tuesday][6] *= 1.25
    found = {x["session"]: x["reasons"] for x in spikes.implausible_readings(prices(spark, [tuple(x) for x in r])).collect()}
    spiky = [i for i in wild if "spike" in found.get(r[i][0], [])]
    assert "spike" in found[r[tuesday][0]] and len(spiky) < 0.05 * len(wild)
    plain = spikes.normal_behaviour(spark.createDataFrame([("A", 1, float(i), float(i)) for i in range(100)] + [("A", 2, None, 5.0)], "ticker string, context int, c double, v double"), "c", "v", "context").collect()
    thin = next(x for x in plain if x["context"] == 2)
    assert (thin["q1"], thin["q3"]) == (24.0, 74.0)  # without readings of its own: the ticker's


def test_compressed_sketches_stay_near_the_quantiles(spark):
    n, k = 200_000, 256
    df = spark.range(n, numPartitions=8).selectExpr("'A' as ticker", "cast(id % 5 as int) as context", "randn(3) as c", "exp(randn(4)) as v")
    exact = df.groupBy("ticker").agg(*[drift.F.percentile(c, p).alias(a) for c, p, a in (("c", 0.25, "q1"), ("c", 0.75, "q3"), ("v", 0.5, "usual"))]).first()
    for row in spikes.normal_behaviour(df, "c", "v", "context", k=k).collect():
        assert all(abs(row[a] - exact[a]) < 0.05 for a in ("q1", "q3", "usual"))
