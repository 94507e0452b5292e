"""Distances, soft memberships and transitions between labelled states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.months import month_index
from ..functions.vectors import cosine_distance, unit
from ..session import small


def centroids(points: DataFrame, spherical: bool = True) -> DataFrame:
    """(label, center): mean of the members, of length one if spherical (members are normalised first).

    Means are built component by component with partial aggregation; NULL labels are left out.
    """
    p = points.filter("label is not null").select("label", F.posexplode(unit(F.col("x")) if spherical else F.col("x")).alias("i", "v"))
    c = p.groupBy("label", "i").agg(F.avg("v").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).getField("m").alias("center"))
    return c.select("label", unit(F.col("center")).alias("center") if spherical else "center")


def distances(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, label, distance) of every point to every center; centers are a handful of states."""
    c = centers.select(F.col("label").alias("center_label"), unit(F.col("center")).alias("center"))
    return points.select("id", unit(F.col("x")).alias("x")).join(small(c), how="cross").select("id", F.col("center_label").alias("label"), cosine_distance(F.col("x"), F.col("center")).alias("distance"))


def nearest(dist: DataFrame) -> DataFrame:
    """(id, label, distance): the nearest center, ties to the smallest label."""
    return dist.groupBy("id").agg(F.min(F.struct("distance", "label")).alias("m")).select("id", "m.label", "m.distance")


def soft_memberships(dist: DataFrame) -> DataFrame:
    """(id, label, p): (1 - d / sum d) / (K - 1), uniform where all distances are zero."""
    w = W.partitionBy("id")
    s, k = F.sum("distance").over(w), F.count("*").over(w)
    return dist.select("id", "label", F.when(s == 0, 1 / k).otherwise((1 - F.col("distance") / F.when(s == 0, 1.0).otherwise(s)) / (k - 1)).alias("p"))


def transitions(labels: DataFrame, states: int, month: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """(by, src, dst, n, p, p_literal, skipped): counts and rates between months that follow each other, for each group.

    p divides by outgoing moves (a state without any stays where it is), p_literal by occurrences; skipped
    is the number of neighbouring rows that aren't a month apart. One row for every pair of `states` states; a
    window holds one group's months, which the calendar bounds.
    """
    by = list(by)
    mi = month_index(F.col(month))
    w = W.partitionBy(*by).orderBy(month)
    steps = labels.select(*by, F.col("label").alias("src"), F.lead("label").over(w).alias("dst"), (F.lead(mi).over(w) - mi).alias("gap"))
    counted = steps.groupBy(*by, "src").agg(F.count("*").alias("occurrences"), *[F.count_if((F.col("gap") == 1) & (F.col("dst") == k)).alias(f"_{k}") for k in range(states)])
    groups = steps.groupBy(*by).agg(F.coalesce(F.count_if(F.col("gap") != 1), F.lit(0)).alias("skipped"))
    all_ = groups.withColumn("src", F.explode(F.array(*[F.lit(k) for k in range(states)]))).join(counted, [*by, "src"], "left").na.fill(0, ["occurrences", *(f"_{k}" for k in range(states))])
    j = all_.select(*by, "src", "occurrences", "skipped", F.posexplode(F.array(*[F.col(f"_{k}") for k in range(states)])).alias("dst", "n"))
    out = F.sum("n").over(W.partitionBy(*by, "src"))
    p = F.when(out == 0, (F.col("src") == F.col("dst")).cast("double")).otherwise(F.col("n") / F.when(out == 0, 1).otherwise(out))
    return j.select(*by, "src", "dst", "n", p.alias("p"), F.coalesce(F.try_divide(F.col("n"), F.col("occurrences")), F.lit(0.0)).alias("p_literal"), "skipped")


def next_probabilities(current: DataFrame, matrix: DataFrame) -> DataFrame:
    """(id, label, p): current memberships times the transition matrix, normalised."""
    j = current.select("id", F.col("label").alias("src"), F.col("p").alias("now")).join(small(matrix.select("src", "dst", F.col("p").alias("move"))), "src")
    q = j.groupBy("id", F.col("dst").alias("label")).agg(F.sum(F.col("now") * F.col("move")).alias("q"))
    return q.select("id", "label", F.try_divide(F.col("q"), F.sum("q").over(W.partitionBy("id"))).alias("p"))


def departures(matrix: DataFrame) -> DataFrame:
    """(src, dst, p, absorbing): where a state goes when it is left; zero throughout for a state that never is."""
    stay = F.max(F.when(F.col("src") == F.col("dst"), F.col("p"))).over(W.partitionBy("src"))
    p = F.when((F.col("src") == F.col("dst")) | (stay >= 1), 0.0).otherwise(F.try_divide(F.col("p"), 1 - stay))
    return matrix.select("src", "dst", p.alias("p"), (stay >= 1).alias("absorbing"))


def modal(current: DataFrame) -> DataFrame:
    """(id, label): the most probable state, ties to the smallest."""
    return current.groupBy("id").agg(F.min(F.struct((-F.col("p")).alias("k"), "label")).alias("m")).select("id", "m.label")


def canonical_order(centers: DataFrame) -> DataFrame:
    """(label, number): states numbered by the lexicographic order of their centers."""
    return centers.select("label", (F.row_number().over(W.orderBy("center")) - 1).alias("number"))


def row_minmax(df: DataFrame, row: str, value: str) -> DataFrame:
    """Add scaled, (value - min) / (max - min) within a row key; 0 for a constant row, NULL stays NULL."""
    w = W.partitionBy(row)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", F.when(F.col(value).isNull(), None).when(hi == lo, 0.0).otherwise(F.try_divide(F.col(value) - lo, hi - lo)))


def islands(flags: DataFrame, flag: str, month: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """(by, first_month, last_month, n_months): spans of months with the flag set; flags hold one row a month and group."""
    by = list(by)
    w = W.partitionBy(*by).orderBy(month)
    new = (F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")
    return flags.withColumn("_new", new).withColumn("_i", F.sum("_new").over(w)).filter(flag).groupBy(*by, "_i").agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.count("*").alias("n_months")).drop("_i")
