"""Top N items of every group: bounded heaps built before the shuffle and merged after it."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.internal import InternalFunction

COMPACT_ROWS = 200_000


def top_n(df: DataFrame, *, groups: Sequence[str], score: str, tie: str, n: int, distinct: bool = True) -> DataFrame:
    """The n rows of each group with the greatest score, equal scores by `tie` ascending, as (groups, tie, score, rank_no).

    Rows whose score is NULL, NaN or infinite, or whose tie is NULL, take no part; NULL group columns form
    groups. With `distinct`, rows equal in groups, score and tie count once: each task keeps, per group,
    the n best different rows seen so far (compacting every COMPACT_ROWS rows, so it holds at most its
    groups' heaps and one buffer, and empties itself when groups alone exceed the buffer: what it sends
    early is merged later). Only these rows are shuffled, by group; duplicates left between tasks are
    dropped there and a JVM bounded heap per group gives the final order. A hot group sends at most n rows
    a task and flush. Without `distinct` the JVM heaps do both sides of the shuffle.
    """
    groups = list(groups)
    rows = df.select(*groups, F.col(tie), F.col(score).cast("double").alias(score)).filter(
        F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")) & F.col(tie).isNotNull()
    )
    rows = rows.withColumn(score, F.when(F.col(score) == 0, 0.0).otherwise(F.col(score)))
    order = ([*groups, score, tie], [*[True] * len(groups), False, True])

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        # only rows that reach the group's n-th different score can be among its best
        pdf = pdf.drop_duplicates()
        g = pdf.groupby(groups, dropna=False, sort=False)
        if len(pdf) > n:
            pdf = pdf[g[score].rank(method="min", ascending=False) <= n]
        return pdf.sort_values(order[0], ascending=order[1]).groupby(groups, dropna=False, sort=False).head(n)

    def heaps(batches):
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= COMPACT_ROWS:
                kept = best(pd.concat(held, ignore_index=True))
                held, size = [kept], len(kept)
                if size > COMPACT_ROWS // 2:
                    yield kept
                    held, size = [], 0
        if size:
            yield best(pd.concat(held, ignore_index=True))

    if distinct:
        rows = rows.mapInPandas(heaps, rows.schema).repartition(*groups).dropDuplicates()
    key = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"), F.col(score).alias("v"))
    merged = rows.groupBy(*groups).agg(InternalFunction.collect_top_k(key, n, True).alias("best"))
    out = merged.select(*groups, F.posexplode(F.array_sort("best")).alias("i", "b"))
    return out.select(*groups, F.col("b.t").alias(tie), F.col("b.v").alias(score), (F.col("i") + 1).cast("int").alias("rank_no"))
