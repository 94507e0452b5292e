"""Similarity clusters by density peaks.

Records are first gathered into cells: a cell is a record with records similar to it, found through hash
tables of random hyperplanes, so a dense region shrinks to few cells and no group of copies is ever paired.
Neighbour joins of the cells' centres give each cell its density, the number of records in its own and the
neighbouring cells, and the distance to its nearest denser neighbour. Cells without a denser neighbour are the
peaks; pointers to denser neighbours are followed to them, which labels every record. Records are then compared
in blocks only where cells of different peaks' groups come near each other, and groups that touch are joined,
so a cluster holds all records connected through similar ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .components import component_roots

BLOCK = 512


def planes(tables: int, bits: int, dim: int, seed: int) -> np.ndarray:
    """Normals of the random hyperplanes, tables * bits x dim."""
    return np.random.default_rng([seed, dim]).standard_normal((tables * bits, dim)).astype(np.float32)


def unit(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x, dim): directions of the vectors that are neither NULL, empty nor all zero and hold only finite numbers; one row an id."""

    def run(batches):
        for pdf in batches:
            rows = {}
            for i, v in enumerate(pdf["y"]):
                if v is not None and len(v):
                    rows.setdefault(len(v), []).append(i)
            for dim, at in rows.items():
                m = np.stack([np.asarray(pdf["y"].iat[i], dtype=float) for i in at])
                big = np.abs(m).max(axis=1)
                ok = np.isfinite(big) & (big > 0)
                m = m[ok] / big[ok, None]
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[np.asarray(at)[ok]], "x": list(m), "dim": dim})

    v = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("y"))
    return v.mapInPandas(run, "id long, x array<double>, dim int").groupBy("id").agg(F.max(F.struct("dim", "x")).alias("m")).select("id", "m.x", "m.dim")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)


def bucket_keys(points: DataFrame, tables: int, bits: int, seed: int, carry: str = "id long") -> DataFrame:
    """(t, dim, bucket, ...) for every hash table t; `carry` lists the columns of points to keep, as a DDL string of longs.

    Vectors of different length never share a bucket. Rows equal in all columns appear once a batch.
    """
    weights = (1 << np.arange(bits)).astype(np.int64)
    kept = [c.split()[0] for c in carry.split(",")]

    def run(batches):
        normals = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                dim = int(dim)
                if dim not in normals:
                    normals[dim] = planes(tables, bits, dim, seed)
                for start in range(0, len(part), 8192):
                    some = part.iloc[start : start + 8192]
                    x = np.stack([np.asarray(v, dtype=np.float32) for v in some["x"]])
                    codes = ((x @ normals[dim].T) > 0).reshape(len(some), tables, bits) @ weights
                    out = {"t": np.tile(np.arange(tables, dtype=np.int32), len(some)), "dim": np.int32(dim), "bucket": codes.ravel()}
                    out |= {c: np.repeat(some[c].to_numpy(), tables) for c in kept}
                    yield pd.DataFrame(out).drop_duplicates()

    return points.select("x", "dim", *kept).mapInPandas(run, f"t int, dim int, bucket long, {carry}")


def tables_needed(bits: int, min_cos: float, miss: float) -> int:
    """Hash tables of `bits` hyperplanes after which a pair at cosine min_cos has gone unseen in all with probability at most `miss`."""
    p = (1 - math.acos(min_cos) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-p)))


def reach(cos: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def density_peaks(
    vectors: DataFrame, *, id_col: str, vec_col: str, min_cos: float = 0.97, bits: int | None = None, miss: float = 1e-6, gather_tables: int = 8, seed: int = 7,
) -> DataFrame:
    """(id, cluster_id, cell, peak, density, delta, x): clusters of vectors connected through cosines of at least min_cos.

    cluster_id is the smallest id of the cluster. density is the number of records in the record's cell and in
    the cells whose centres are similar to its own, delta the angle from its cell to the nearest denser
    neighbour (NULL for a peak), peak the cell that the pointers lead to. Vectors that are NULL, empty, all zero
    or not finite are left out; vectors of different length are never similar. Repeated ids count once.

    Buckets have log2 of the number of vectors as bits (or `bits`), so that their size doesn't grow with the
    table, and as many tables as make a pair at cosine min_cos go unseen with probability `miss` at most; more
    similar pairs are safer still, and a cluster falls apart only if all its bridges go unseen. Every candidate
    is verified exactly. Buckets meet as sets of cells, whose number in a region is bounded whatever the number
    of records there; where one is crowded all the same, adaptive execution splits the join.
    """
    theta = math.acos(min_cos)
    points = cut(unit(vectors, id_col, vec_col))
    bits = bits or min(40, max(8, math.ceil(math.log2(max(2, points.count())))))
    link_tables = tables_needed(bits, min_cos, miss)
    bucket = ["t", "dim", "bucket"]

    # cells: in every bucket the smallest id is the centre; a record joins the smallest centre similar to it
    keys = bucket_keys(points, gather_tables, bits, seed)
    centre = keys.groupBy(*bucket).agg(F.min("id").alias("c"))
    near = keys.join(centre, bucket).filter("id <> c").select("id", "c").distinct()
    xs = points.select(F.col("id").alias("c"), F.col("x").alias("cx"))
    joined = near.join(points.select("id", "x"), "id").join(xs, "c").filter(dot("x", "cx") >= min_cos).groupBy("id").agg(F.min("c").alias("c"))
    roots = cut(component_roots(joined, "id", "c"))
    cells = points.join(roots.select(F.col("node").alias("id"), F.col("root").alias("r")), "id", "left").select("id", "x", "dim", F.coalesce("r", "id").alias("cell"))
    centres = cells.filter("id = cell").select("cell", F.col("x").alias("px"), "dim")
    cells = cut(cells.join(centres.select("cell", "px"), "cell").withColumn("away", reach(dot("x", "px"))).drop("px"))
    spread = cells.groupBy("cell").agg(F.count("*").alias("size"), F.max("away").alias("radius"))
    summary = cut(centres.join(spread, "cell"))

    # neighbour join of the centres: densities and pointers to the nearest denser neighbour
    seen = bucket_keys(summary.withColumnRenamed("px", "x"), link_tables, bits, seed + 1, "cell long")
    busy = lambda df, by: cut(df.join(df.groupBy(*bucket).agg(F.min(by).alias("lo"), F.max(by).alias("hi")).filter("lo <> hi").select(*bucket), bucket))
    shared = busy(seen, "cell")
    pairs = shared.alias("p").join(shared.alias("q"), bucket).filter("p.cell < q.cell").select(F.col("p.cell").alias("a"), F.col("q.cell").alias("b")).distinct()
    s = lambda k: summary.select(F.col("cell").alias(k), F.col("px").alias(f"x{k}"), F.col("radius").alias(f"r{k}"), F.col("size").alias(f"n{k}"))
    sure = cut(pairs.join(s("a"), "a").join(s("b"), "b").withColumn("cos", dot("xa", "xb")).filter(F.col("cos") >= min_cos).select("a", "b", "cos", "na", "nb"))
    way = sure.select("a", "b", "cos", "nb").union(sure.select("b", "a", "cos", "na"))
    around = way.groupBy(F.col("a").alias("cell")).agg(F.sum("nb").alias("around"))
    dense = cut(summary.join(around, "cell", "left").select("cell", (F.col("size") + F.coalesce("around", F.lit(0))).alias("density")))
    way = way.join(dense.select(F.col("cell").alias("a"), F.col("density").alias("da")), "a").join(dense.select(F.col("cell").alias("b"), F.col("density").alias("db")), "b")
    denser = way.filter((F.col("db") > F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("b") < F.col("a"))))
    pointer = denser.groupBy("a").agg(F.min(F.struct(reach(F.col("cos")).alias("delta"), F.col("b").alias("to"))).alias("m")).select(F.col("a").alias("cell"), F.col("m.to").alias("to"), F.col("m.delta").alias("delta"))
    heads = cut(dense.join(pointer, "cell", "left").select("cell", "density", F.coalesce("to", "cell").alias("peak"), "delta"))
    while True:  # pointers double their reach each round; density rises along them, so they end in peaks
        up = heads.select(F.col("cell").alias("peak"), F.col("peak").alias("higher"))
        jumped = cut(heads.join(up, "peak").select("cell", "density", F.col("higher").alias("peak"), "delta", (F.col("higher") != F.col("peak")).alias("moved")))
        heads = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            break

    # groups of peaks that are joined by similar centres already; what follows only compares different groups
    head = lambda k: heads.select(F.col("cell").alias(k), F.col("peak").alias(f"k{k}"))
    linked = sure.select("a", "b").join(head("a"), "a").join(head("b"), "b").filter("ka <> kb").select("ka", "kb").distinct()
    group = cut(component_roots(linked, "ka", "kb")).select(F.col("node").alias("peak"), F.col("root").alias("g"))
    heads = cut(heads.join(group, "peak", "left").select("cell", "density", "peak", "delta", F.coalesce("g", "peak").alias("g")))
    touching = _touching(cells, summary, heads.select("cell", "g"), min_cos, bits, link_tables, seed + 1, busy)
    merged = cut(component_roots(touching, "ga", "gb")).select(F.col("node").alias("g"), F.col("root").alias("top"))
    label = heads.join(merged, "g", "left").select("cell", "density", "delta", "peak", F.coalesce("top", "g").alias("top"))
    smallest = cells.groupBy("cell").agg(F.min("id").alias("low")).join(label, "cell").groupBy("top").agg(F.min("low").alias("cluster_id"))
    label = label.join(smallest, "top").drop("top")
    return cells.select("id", "x", "cell").join(label, "cell").select("id", "cluster_id", "cell", "peak", "density", "delta", "x")


def _touching(cells: DataFrame, summary: DataFrame, group: DataFrame, min_cos: float, bits: int, tables: int, seed: int, busy) -> DataFrame:
    """(ga, gb): groups with a similar pair of records. Pairs of cells whose centres and radii leave room for one are
    compared record by record, in blocks of bounded size, and only records within reach of the other cell take part."""
    bucket = ["t", "dim", "bucket"]
    theta = math.acos(min_cos)
    seen = bucket_keys(cells.select("x", "dim", "cell"), tables, bits, seed, "cell long").distinct()
    shared = busy(seen.join(group, "cell"), "g")
    pairs = shared.alias("p").join(shared.alias("q"), bucket).filter("p.g < q.g").select(F.col("p.cell").alias("a"), F.col("q.cell").alias("b"), F.col("p.g").alias("ga"), F.col("q.g").alias("gb")).distinct()
    s = lambda k: summary.select(F.col("cell").alias(k), F.col("px").alias(f"x{k}"), F.col("radius").alias(f"r{k}"))
    pairs = cut(pairs.join(s("a"), "a").join(s("b"), "b").filter(reach(dot("xa", "xb")) <= theta + F.col("ra") + F.col("rb") + 1e-9))
    sides = [
        pairs.select(F.col(k).alias("cell"), "a", "b", "ga", "gb", F.col(f"x{o}").alias("ox"), F.col(f"r{o}").alias("orad")).join(cells.select("cell", "id", "x"), "cell")
        .filter(reach(dot("x", "ox")) <= theta + F.col("orad") + 1e-9).select("a", "b", "ga", "gb", F.lit(k).alias("side"), "id", "x")
        for k, o in (("a", "b"), ("b", "a"))
    ]
    members = cut(sides[0].union(sides[1]))
    n = lambda k: F.ceil(F.count_if(F.col("side") == k) / BLOCK).cast("int").alias(f"n{k}")
    counts = members.groupBy("a", "b").agg(n("a"), n("b")).filter("na > 0 and nb > 0")
    placed = members.join(counts, ["a", "b"])
    mine = F.when(F.col("side") == "a", F.col("na")).otherwise(F.col("nb"))
    others = F.when(F.col("side") == "a", F.col("nb")).otherwise(F.col("na"))
    placed = placed.withColumns({"own": F.pmod(F.xxhash64("id"), mine).cast("int"), "other": F.explode(F.sequence(F.lit(0), others - 1))})
    placed = placed.select("a", "b", "ga", "gb", F.when(F.col("side") == "a", F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("side") == "a", F.col("other")).otherwise(F.col("own")).alias("j"), "side", "x")

    def touch(pdf: pd.DataFrame) -> pd.DataFrame:
        m = {k: np.stack(pdf.loc[pdf["side"] == k, "x"].to_list()) for k in ("a", "b") if (pdf["side"] == k).any()}
        hit = len(m) == 2 and bool(((m["a"] @ m["b"].T) >= min_cos).any())
        return pdf[["ga", "gb"]].head(int(hit))

    return placed.groupBy("a", "b", "i", "j").applyInPandas(touch, "ga long, gb long").distinct()


def describe_clusters(clustered: DataFrame, members: int = 3, by: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """Each cluster's size, cells, peaks, greatest density and most typical members: those nearest to its mean direction.

    With by=("cluster_id", "peak") the same for the part of a cluster that leads to each of its peaks. The
    members are chosen by bounded heaps; no cluster is gathered in one place.
    """
    from .topn import top_n

    by = list(by)
    mean = clustered.select(*by, F.posexplode("x").alias("i", "v")).groupBy(*by, "i").agg(F.avg("v").alias("m")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(*by, F.col("c.m").alias("c"))
    scored = clustered.join(mean, by).select(*by, "id", F.round(dot("x", "c"), 12).alias("closeness"))
    top = top_n(scored, groups=by, score="closeness", tie="id", n=members, distinct=False).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank_no", "id"))).getField("id").alias("typical"))
    size = clustered.groupBy(*by).agg(F.count("*").alias("size"), F.count_distinct("cell").alias("cells"), F.count_distinct("peak").alias("peaks"), F.max("density").alias("peak_density"))
    return size.join(top, by).select(*by, "size", "cells", "peaks", "peak_density", "typical") if "peak" not in by else size.join(top, by).select(*by, "size", "cells", "peak_density", "typical")
