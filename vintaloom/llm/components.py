"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def component_roots(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) with root the smallest node of the component, for every node in a link.

    Each round links every node's neighbours to the smallest one near it (alternating larger and smaller
    neighbours), which needs a logarithmic number of rounds; all rounds run on the cluster and cut their
    lineage by checkpoints. Self links and NULLs count for nothing but make their node known.
    """
    raw = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    edges = cut(raw.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = raw.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    for _ in range(max_rounds):
        # larger neighbours of every node move to the smallest node next to it
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # smaller neighbours of every node move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low, "u")
        small = j.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(j.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = cut(small)
        same = new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
