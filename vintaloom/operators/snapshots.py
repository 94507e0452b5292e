"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def snapshot_changes(rows: DataFrame, *, snapshot: str, keys: Sequence[str], value: str, state: str, tolerance: float = 1e-9) -> DataFrame:
    """Added, removed and changed keys of each snapshot against the one before it in the table.

    Every row is tagged once as the new side of its own snapshot and once as the old side of the next; one
    aggregation on (snapshot, keys) then holds a row hash, the BOOLEAN `state` (value is usable) and the
    value of either side. Equal hashes end the comparison; otherwise a change is a different state, or two
    usable values that differ by more than tolerance of the larger magnitude. Repeated rows count once; of
    differing rows with one key in a snapshot the one with the greatest (state, value) counts. Rows without
    a snapshot or with a NULL key column are compared like others, except that a NULL snapshot is left out.
    The list of snapshots is bounded by the calendar and is broadcast. Partial aggregation makes a hot key
    at most one row per task before the shuffle.
    """
    later = (
        rows.filter(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("_s")).distinct()
        .select("_s", F.lead("_s").over(W.orderBy("_s")).alias("_after"), (F.lag("_s").over(W.orderBy("_s")).isNull()).alias("_first"))
    )
    v = F.when(F.col(state), F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.col(value)))
    side = F.struct(F.col(state).alias("ok"), v.alias("v"), F.xxhash64(F.col(state), v).alias("h"))
    tagged = (
        rows.select(*[F.col(k) for k in keys], F.col(snapshot).alias("_s"), side.alias("_side"))
        .join(F.broadcast(later), "_s")
        .select(*keys, "_side", F.explode(F.array_compact(F.array(
            F.when(~F.col("_first"), F.struct(F.col("_s").alias("at"), F.lit(True).alias("new"))),
            F.when(F.col("_after").isNotNull(), F.struct(F.col("_after").alias("at"), F.lit(False).alias("new"))),
        ))).alias("_t"))
    )
    both = tagged.groupBy(F.col("_t.at").alias(snapshot), *keys).agg(
        F.max(F.when(F.col("_t.new"), F.col("_side"))).alias("n"), F.max(F.when(~F.col("_t.new"), F.col("_side"))).alias("o")
    )
    a, b = F.col("o.v"), F.col("n.v")
    moved = F.abs(a - b) > tolerance * F.greatest(F.abs(a), F.abs(b))
    changed = (F.col("o.h") != F.col("n.h")) & ((F.col("o.ok") != F.col("n.ok")) | F.coalesce(moved, F.lit(False)))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(changed, "changed")
    return both.withColumn("change_kind", kind).filter(F.col("change_kind").isNotNull()).select(
        snapshot, *keys, "change_kind", F.col("o.v").alias("old_value"), F.col("n.v").alias("new_value")
    )
