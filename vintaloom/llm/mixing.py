"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut

BUCKETS = 65_536


def uniform(seed: int, *cols: str) -> Column:
    """A number strictly between 0 and 1, fixed by the seed and the columns."""
    h = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), F.lit(1 << 52))
    return (h + F.lit(0.5)) / F.lit(float(1 << 52))


def mix_sources(
    items: DataFrame, targets: DataFrame, *, id_col: str, source_col: str, size_col: str, weight_col: str | None = None, size: int | None = None, seed: int = 1,
) -> DataFrame:
    """Copies of each item per mix: (mix_name, source, id, n_tokens, copies), rows with at least one copy.

    A source's quota is its target share of the collection's size (default: all tokens there are), but at
    most max_repeats times its own tokens; a shortfall isn't made up by other sources, so these keep their
    shares of the size asked for. An item's expected copies are in proportion to its weight (1, or a positive
    column), at most max_repeats; what heavy items lose by that limit goes to the others of their source, so
    expected tokens meet the quota unless items of weight 0 stand in the way. The whole part of the expected
    copies is certain. The fraction p is
    drawn by Pareto order sampling: items in the order of (u / (1 - u)) / (p / (1 - p)), u uniform and fixed
    by seed, mix and id, are taken until the source's tokens reach the quota, so the total is fixed up to
    part of one item and no item exceeds max_repeats. The boundary is found through a histogram of the order
    (BUCKETS parts), so only the boundary's part of a source is ever sorted.

    Repeated ids count once (greatest size). Items of NULL source, id or size, of no size, or of a source the mix doesn't name, take no part.
    """
    w = F.lit(1.0) if weight_col is None else F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))
    base = items.filter(F.col(id_col).isNotNull() & F.col(source_col).isNotNull() & (F.col(size_col) > 0))
    base = base.groupBy(F.col(id_col).alias("id")).agg(F.max(F.struct(F.col(size_col).cast("long").alias("n_tokens"), F.col(source_col).alias("source"), F.greatest(w, F.lit(0.0)).alias("w"))).alias("x")).select("id", "x.*")
    base = cut(base)
    totals = base.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.sum(F.col("w") * F.col("n_tokens")).alias("weighted"), F.max("w").alias("heaviest"))
    everything = size if size is not None else (base.agg(F.sum("n_tokens")).first()[0] or 0)
    mixes = targets.filter("mix_name is not null and source is not null and target_share > 0 and max_repeats > 0").groupBy("mix_name", "source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    quota = mixes.join(totals, "source").withColumn("quota", F.least(F.floor(F.col("share") * F.lit(everything)), F.col("repeats") * F.col("have")).cast("double"))
    quota = _scaled(base, quota)
    drawn = base.join(quota, "source").withColumn("e", F.least(F.col("repeats").cast("double"), F.col("scale") * F.col("w")))
    # a fraction within rounding of a whole copy is a whole copy
    drawn = drawn.withColumn("whole", F.floor(F.col("e") + 1e-12)).withColumn("p", F.greatest(F.col("e") - F.col("whole"), F.lit(0.0)))
    u = uniform(seed, "mix_name", "id")
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    drawn = drawn.withColumn("order", F.when((F.col("p") > 0) & (F.col("whole") < F.col("repeats")), odds / (1 + odds)))
    drawn = drawn.withColumn("part", F.floor(F.col("order") * BUCKETS).cast("int"))
    by = ["mix_name", "source"]
    certain = drawn.groupBy(*by).agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("sure"))
    parts = drawn.filter("part is not null").groupBy(*by, "part").agg(F.sum("n_tokens").alias("t"))
    parts = parts.withColumn("before", F.sum("t").over(W.partitionBy(*by).orderBy("part")) - F.col("t"))
    need = certain.join(quota, by).select(*by, (F.col("quota") - F.col("sure")).alias("need"))
    parts = cut(parts.join(need, by).select(*by, "part", "before", "need", (F.col("before") + F.col("t") <= F.col("need")).alias("all_in"), (F.col("before") < F.col("need")).alias("some_in")))
    edge = drawn.join(parts.filter("some_in and not all_in").select(*by, "part", "before", "need"), [*by, "part"])
    run = F.sum("n_tokens").over(W.partitionBy(*by).orderBy("order", "id").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("before")
    # the item that crosses the quota is taken if that leaves the total nearer to it
    edge = edge.withColumn("run", run).filter((F.col("run") <= F.col("need")) | (F.col("run") - F.col("need") < F.col("need") - (F.col("run") - F.col("n_tokens")))).filter(F.col("run") - F.col("n_tokens") < F.col("need"))
    inside = drawn.join(parts.filter("all_in").select(*by, "part"), [*by, "part"], "left_semi")
    cols = ["mix_name", "source", "id", "n_tokens"]
    extra = inside.select(*cols, F.lit(1).alias("copies")).unionByName(edge.select(*cols, F.lit(1).alias("copies")))
    sure = drawn.filter("whole > 0").select(*cols, F.col("whole").cast("int").alias("copies"))
    return sure.unionByName(extra).groupBy(*cols).agg(F.sum("copies").cast("int").alias("copies"))


def _scaled(base: DataFrame, quota: DataFrame) -> DataFrame:
    """(mix_name, source, repeats, quota, scale): expected copies min(repeats, scale * w) whose tokens sum to the quota.

    Items at the limit of repeats leave the sum and the scale of the others rises, until no further item
    reaches the limit. The lines of the targets pass the driver; a round is needed only where a limit binds.
    """
    lines = [r.asDict() for r in quota.select("mix_name", "source", "repeats", "quota", "have", "weighted", "heaviest").collect()]
    for r in lines:
        r["scale"] = r["quota"] / r["weighted"] if r["weighted"] else 0.0
    schema = "mix_name string, source string, repeats int, quota double, scale double"
    table = lambda: base.sparkSession.createDataFrame([tuple(r[c] for c in ("mix_name", "source", "repeats", "quota", "scale")) for r in lines], schema)
    bound = [r for r in lines if r["heaviest"] * r["scale"] > r["repeats"] * (1 + 1e-12)]
    while bound:
        full = F.col("w") * F.col("scale") >= F.col("repeats")
        sums = base.join(table(), "source").groupBy("mix_name", "source").agg(F.sum(F.when(full, F.col("n_tokens")).otherwise(0)).alias("t"), F.sum(F.when(full, 0.0).otherwise(F.col("w") * F.col("n_tokens"))).alias("free"))
        seen = {(r["mix_name"], r["source"]): r for r in sums.collect()}
        moved = []
        for r in bound:
            at = seen[r["mix_name"], r["source"]]
            scale = (r["quota"] - r["repeats"] * at["t"]) / at["free"] if at["free"] > 0 else r["scale"]
            if scale > r["scale"] * (1 + 1e-12):
                r["scale"] = scale
                moved.append(r)
        bound = moved
    return table()


def shares_reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target and reached share of the mix's tokens, tokens, items and most copies of an item."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("items"), F.max("copies").alias("most_copies"))
    t = targets.filter("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = t.join(got, ["mix_name", "source"], "left").na.fill({"tokens": 0, "items": 0, "most_copies": 0})
    return j.withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy("mix_name"))), F.lit(0.0)))
