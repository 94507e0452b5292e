import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("vintaloom.llm")
from vintaloom.llm import abuse, components, mixing, packing, peaks, tokens, topn  # noqa: E402


# top N


def brute_top(rows, n):
    groups = {}
    for g, t, v in {(g, t, v) for g, t, v in rows}:
        if v is not None and t is not None and np.isfinite(v):
            groups.setdefault(g, []).append((-v, t))
    return {(g, t, i + 1) for g, items in groups.items() for i, (_, t) in enumerate(sorted(items)[:n])}


def test_top_n_with_ties_repeats_and_nulls(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a"] * 5 + ["b", "c", None]), rnd.choice("tuvwxyz") + str(i % 40) if i % 17 else None, rnd.choice([1.0, 2.0, 2.0, -0.0, 0.0, float("nan"), float("inf"), None])) for i in range(800)]
    rows = [(g, t, 0.0 if v == 0 else v) for g, t, v in rows]
    df = spark.createDataFrame([(g, t, v, 7, 8) for g, t, v in rows + rows[:300]], "g string, t string, v double, rank_no int, best int")
    for limit in (topn.COMPACT_ROWS, 16):
        monkeypatch.setattr(topn, "COMPACT_ROWS", limit)
        got = {(r["g"], r["t"], r["rank_no"]) for r in topn.top_n(df, groups=["g"], score="v", tie="t", n=3).collect()}
        assert got == brute_top(rows, 3)
    assert topn.top_n(df.limit(0), groups=["g"], score="v", tie="t", n=3).count() == 0
    plain = topn.top_n(df.select("g", "t", "v").distinct(), groups=["g"], score="v", tie="t", n=2, distinct=False)
    assert {(r["g"], r["t"], r["rank_no"]) for r in plain.collect()} == brute_top(rows, 2)


# clusters


def brute_clusters(vectors, min_cos):
    ok = {i: np.array(v, float) for i, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    x = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    near, label = x @ x.T >= min_cos, {}
    for s in range(len(ids)):
        if s in label:
            continue
        todo = [s]
        while todo:
            k = todo.pop()
            if k not in label:
                label[k] = ids[s]
                todo += list(np.flatnonzero(near[k]))
    return {ids[k]: v for k, v in label.items()}


def test_density_peaks_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8))
    vectors = [(i, list(map(float, (centers[i % 6] + rng.normal(0, 0.06, 8)) * rng.choice([0.01, 1, 1e6])))) for i in range(240)]
    a, b = centers[0] / np.linalg.norm(centers[0]), centers[1] / np.linalg.norm(centers[1])
    vectors += [(500 + k, list(map(float, a + (b - a) * k / 30))) for k in range(31)]  # a chain joins two groups
    vectors += [(700, vectors[3][1]), (701, [2 * v for v in vectors[3][1]]), (702, []), (703, None), (704, [0.0] * 8), (705, [1.0, None] + [0.0] * 6), (706, [float("nan")] * 8), (707, list(map(float, rng.normal(size=8))))]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in vectors + vectors[:5]], "k long, v array<double>, cell string, id int")
    out = peaks.density_peaks(df, id_col="k", vec_col="v")
    got = {r["id"]: r["cluster_id"] for r in out.collect()}
    want = brute_clusters(vectors, 0.97)
    assert got == want and len(set(want.values())) < 8
    # a peak has no denser neighbour, and density doesn't fall along the pointers
    rows = {r["id"]: r for r in out.collect()}
    for r in rows.values():
        assert rows[r["peak"]]["cluster_id"] == r["cluster_id"] and rows[r["peak"]]["density"] >= r["density"]
        assert (rows[r["cell"]]["delta"] is None) == (r["peak"] == r["cell"])
    parts = peaks.describe_clusters(out, by=("cluster_id", "peak")).collect()
    assert sum(r["size"] for r in parts) == len(want) and len(parts) > len(set(want.values()))  # the chain is split at its peaks
    d = {r["cluster_id"]: r for r in peaks.describe_clusters(out).collect()}
    assert sum(r["size"] for r in d.values()) == len(want) and all(len(r["typical"]) == min(3, r["size"]) for r in d.values())
    assert peaks.density_peaks(df.limit(0), id_col="k", vec_col="v").count() == 0


def test_lengths_don_t_mix_and_tables_grow_with_bits(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [3.0, 0.0, 0.0]), (5, [-1.0, 0.0])]
    out = peaks.density_peaks(spark.createDataFrame(rows, "k long, v array<double>"), id_col="k", vec_col="v")
    assert {r["id"]: r["cluster_id"] for r in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    for bits in (8, 20, 30):
        p = (1 - np.arccos(0.97) / np.pi) ** bits
        assert (1 - p) ** peaks.tables_needed(bits, 0.97, 1e-6) <= 1e-6


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 1)]
    got = {r["node"]: r["root"] for r in components.component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {n: n for e in links if None not in e for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        if a is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {n: find(n) for n in parent}


# packing


def test_plan_places_everything_and_is_near_the_bound():
    rnd = random.Random(4)
    hist = {rnd.randrange(20, 400): rnd.randrange(1, 60) for _ in range(150)}
    plan = packing.plan_containers(hist, 512)
    used = {}
    for config, copies in plan.configurations:
        assert sum(k * a for k, a in config.items()) <= 512
        for k, a in config.items():
            used[k] = used.get(k, 0) + a * copies
    assert used == hist and plan.bound <= plan.containers <= plan.bound * 1.05
    assert packing.plan_containers({}, 512).containers == 0 and packing.plan_containers({512: 3, 1: 1}, 512).containers == 4
    # halves and thirds: the bound of the program is reached
    assert packing.plan_containers({60: 30, 40: 30}, 100).containers == 30


def test_pack(spark, tmp_path):
    rnd = random.Random(6)
    sizes = {i: rnd.choice([100, 100, rnd.randrange(1, 900), 0]) for i in range(400)} | {1000: 5000}
    rows = [(i, n, "c") for i, n in sizes.items()] + [(3, sizes[3], "c"), (None, 5, "c"), (2000, None, "c")]
    df = spark.createDataFrame(rows, "id long, n long, container_id string")
    targets = spark.createDataFrame([("s", 256), ("l", 2048), (None, 5)], "container_kind string, capacity_tokens int")
    packed = packing.pack(df, targets, id_col="id", size_col="n", rounds=50, salts=3)
    got = packed.placed.toPandas()
    for kind, cap in (("s", 256), ("l", 2048)):
        p = got[got.container_kind == kind]
        assert p.groupby("container_id").n_tokens.sum().max() <= cap and not p.duplicated(["id", "piece_no"]).any()
        assert dict(p.groupby("id").n_tokens.sum()) == {i: n for i, n in sizes.items() if n}
        assert (p.groupby("id").size() == p.id.drop_duplicates().map(lambda i: -(-sizes[i] // cap)).set_axis(p.id.drop_duplicates()).sort_index()).all()
        assert sorted(p[p.id == 1000].start_token) == list(range(0, 5000, cap))
    report = {r["container_kind"]: r for r in packing.packing_report(packed).collect()}
    assert report["l"]["fill_rate"] > 0.9 and report["s"]["containers"] >= report["s"]["least_containers"]
    packed.placed.write.parquet(str(tmp_path / "placed"))  # the report needs only the two tables
    packed.plan.write.parquet(str(tmp_path / "plan"))
    again = packing.Packed(*[spark.read.parquet(str(tmp_path / n)) for n in ("placed", "plan")])
    assert {r["container_kind"]: r for r in packing.packing_report(again).collect()} == report
    good = packing.balance(packed, df, id_col="id", size_col="n").collect()
    assert {tuple(r)[1:] for r in good} == {(len([n for n in sizes.values() if n]), 0, 0, 0, 0)}
    lost = packing.Packed(packed.placed.filter("container_id > 0"), packed.plan)
    assert all(r["items"] < good[0]["items"] or r["tokens_missing"] > 0 for r in packing.balance(lost, df, id_col="id", size_col="n").collect())
    assert packing.pack(df.limit(0), targets, id_col="id", size_col="n").placed.count() == 0
    assert packing.packing_report(packing.pack(df, targets.limit(0), id_col="id", size_col="n")).count() == 0


# mixing


def test_mix(spark):
    rnd = random.Random(7)
    docs = [(i, "big" if i % 3 else "small", rnd.randrange(50, 150), 1.0 + i % 2) for i in range(900)]
    df = spark.createDataFrame(docs + docs[:50] + [(None, "big", 5, 1.0), (5000, None, 5, 1.0), (5001, "big", 0, 1.0), (5002, "other", 100, 1.0)], "id long, source string, n long, w double").withColumn("mix_name", F.lit("clash"))
    t = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 4), ("cap", "small", 0.9, 2), ("cap", "big", 0.1, 1)], "mix_name string, source string, target_share double, max_repeats int")
    mixed = mixing.mix_sources(df, t, id_col="id", source_col="source", size_col="n")
    rows = mixed.toPandas()
    total = sum(n for _, _, n, _ in docs) + 100
    got = {(r.mix_name, r.source): int((g.n_tokens * g.copies).sum()) for (r, g) in ((g.iloc[0], g) for _, g in rows.groupby(["mix_name", "source"]))}
    assert abs(got["m", "big"] - total // 2) <= 150 and abs(got["m", "small"] - total // 2) <= 150
    small = sum(n for _, s, n, _ in docs if s == "small")
    assert got["cap", "small"] == 2 * small and rows[rows.source == "small"].groupby("mix_name").copies.max()["cap"] == 2
    sub = rows[(rows.mix_name == "m") & (rows.source == "small")]
    assert set(sub.copies) == {1, 2} and len(sub) == 300  # certain whole copies, the rest drawn
    s = {(r["mix_name"], r["source"]): r["reached_share"] for r in mixing.shares_reached(mixed, t).collect()}
    assert s["m", "big"] == pytest.approx(0.5, abs=0.01)
    assert sorted(map(tuple, mixing.mix_sources(df.repartition(7), t, id_col="id", source_col="source", size_col="n").toPandas().values.tolist())) == sorted(map(tuple, rows.values.tolist()))
    assert mixing.mix_sources(df.limit(0), t, id_col="id", source_col="source", size_col="n").count() == 0


def test_mix_draws_by_weight(spark):
    df = spark.range(4000).select("id", F.lit("s").alias("source"), F.lit(10).alias("n"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    t = spark.createDataFrame([("m", "s", 0.25, 1)], "mix_name string, source string, target_share double, max_repeats int")
    got = mixing.mix_sources(df, t, id_col="id", source_col="source", size_col="n", weight_col="w").toPandas()
    assert len(got) == 1000 and 0.70 < (got.id % 2 == 0).mean() < 0.80
    # items at the limit of their repeats leave the rest of the quota to the others
    for repeats, share in ((1, 0.75), (2, 0.9)):
        heavy = df.withColumn("w", F.when(F.col("id") % 4 == 0, 50.0).otherwise(1.0))
        t = spark.createDataFrame([("m", "s", share, repeats)], "mix_name string, source string, target_share double, max_repeats int")
        got = mixing.mix_sources(heavy, t, id_col="id", source_col="source", size_col="n", weight_col="w").toPandas()
        assert abs(int((got.n_tokens * got.copies).sum()) - 40_000 * share) <= 10 and set(got[got.id % 4 == 0].copies) == {repeats} and (got.id % 4 == 0).sum() == 1000


# abuse


def code(text):
    return [c for c in abuse.skeleton([text])[0].tolist() if c != abuse.BREAK]


@pytest.mark.parametrize("odd", ["THE FILTHY RATS", "th3 f1l7hy r47$", "The fіlthу rаts", "the f​ilt​hy ra­ts", "t h e f i l t h y r a t s", "theeee filthyyy ratsss", "the f*lthy r*ts", "the fi?lthy ra�ts", "the f.i.l.t.h.y rats", "the fiÂ­lthy ratâ\u0080\u008bs", "thé fïlthy räts"])
def test_disguises_meet_their_plain_form(odd):
    assert code(odd) == code("the filthy rats")


def test_repair_and_numbers():
    assert abuse.repair("ConfiguraciÃ³n Ã¼ber weiÃŸ") == "Configuración über weiß" and abuse.repair("Ârger Ãb") == "Ârger Ãb"
    assert code("in 1993 and 47") == code("in and") and code("") == [] and code("\U0001f600 ...") == []


def pages(n, seed):
    rnd = random.Random(seed)
    calm = ["the {} was opened near the {}", "our {} ships within days from the {}", "please bring a {} and a {}", "the {} team beat the {} in a match", "a {} is no vermin, said the {} office"]
    rude = ["you are a filthy {} and a worthless idiot", "get lost you stupid brainless {}", "all {} are vermin and should be driven out"]
    nouns = "lease oven garden router tram nurse canal lantern museum harbour cable thesis".split()
    out = []
    for i in range(n):
        bad = i % 4 == 0
        body = [rnd.choice(calm).format(rnd.choice(nouns), rnd.choice(nouns)) for _ in range(6)]
        if bad:
            body.insert(rnd.randrange(7), rnd.choice(rude).format(rnd.choice(nouns)))
        out.append((i, ". ".join(body) + ".", int(bad)))
    return out


def test_held_out_accuracy():
    train, test = pages(300, 1), pages(300, 2)
    noisy = [1 - y if i % 25 == 3 else y for i, _, y in train]
    model = abuse.train([t for _, t, _ in train], np.array(noisy))
    flagged = model.scores([t for _, t, _ in test]) >= model.threshold
    assert (flagged == np.array([y for *_, y in test])).mean() > 0.97
    long = " ".join(["the lease was opened near the oven."] * 20_000)
    assert model.scores([long + " you are a filthy nurse and a worthless idiot.", long, "", "Ok"]).round().tolist()[:3] == [1, 0, 0]
    # one pass over several texts gives what each gives alone
    texts = [t for _, t, _ in test[:20]] + ["", "no end"]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])


def test_scores_and_rates(spark):
    docs = pages(120, 3)
    df = spark.createDataFrame([(i, t, "s" if i % 2 else None, 1) for i, t, _ in docs] + [(900, None, "s", 1), (901, "", "s", 1), (None, "hello you", "s", 1)], "doc_id long, text string, source string, label int")
    lab = spark.createDataFrame([(i, y, a) for i, _, y in docs for a in ("x", "y")] + [(1, 1, "z"), (None, 1, "z"), (2, None, "z"), (7777, 1, "z")], "doc_id long, is_abusive int, annotator string")
    model = abuse.fit_abuse(df, lab)
    out = abuse.score_pages(df, model)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 123 and sum(got[i]["flagged"] == bool(y) for i, _, y in docs) >= 116 and got[900]["score"] == 0 and not got[901]["flagged"]
    r = {x["source"]: x for x in abuse.rates(out).collect()}
    assert r[None]["pages"] == 60 and 0.3 < r[None]["rate"] < 0.7
    empty = abuse.fit_abuse(df, lab.limit(0))
    assert abuse.score_pages(df, empty).filter("flagged").count() == 0 and abuse.score_pages(df.limit(0), model).count() == 0


def test_token_counts(spark):
    import os

    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary")
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("a" * 30_000,), ("<|endoftext|>",)], "t string")
    n = [r[0] for r in df.select(tokens.token_count(F.col("t"))).collect()]
    assert n[0] == 2 and n[1] == n[2] == 0 and n[3] > 100 and n[4] > 1


@pytest.fixture(scope="module")
def queries():
    from vintaloom.llm import queries as q

    return q


@pytest.mark.parametrize("name", ["p5_clusters", "p8_report", "p9_shares", "p10_rates"])
def test_queries_run(spark, small, queries, name):
    assert queries.QUERIES[name](spark, small).count() > 0




def test_program_is_never_worse_than_largest_first():
    rnd = random.Random(9)
    for cap in (64, 512, 2048):
        hist = {rnd.randrange(1, cap): rnd.randrange(1, 80) for _ in range(200)}
        n, lengths = np.array([float(hist[k]) for k in sorted(hist)]), np.array(sorted(hist))
        assert packing.plan_containers(hist, cap).containers <= packing._finish({}, n, lengths, cap, 0.0, False).containers


def test_packing_covers_every_length():
    hist = {2050 + 7 * i: 3 + i % 4 for i in range(280)}  # between a quarter and half of a container
    plan = packing.plan_containers(hist, 8192)
    used = {}
    for config, copies in plan.configurations:
        assert sum(k * a for k, a in config.items()) <= 8192
        for k, a in config.items():
            used[k] = used.get(k, 0) + a * copies
    assert used == hist and plan.program + plan.rest == sum(hist.values())
    few = packing.plan_containers(hist, 8192, rounds=60)  # as many as were run before
    assert plan.program > few.program and plan.containers <= few.containers
