"""Filling containers of fixed capacity with texts, measured in tokens.

The configuration linear program over the length histogram is solved by multiplicative weights. A length's
price is its size times a weight that grows with how far it lags behind the common progress; knapsack dynamic
programming finds the value of the best configuration at these prices and, from the same table, the best
configuration through every length. All that come near the best value advance together by small steps, so
every length is covered in proportion and what is left stays a small copy of the whole. The fractional solution
is rounded to whole containers and the rest is filled largest-first. The plan is a list of (configuration,
copies), bounded by the number of lengths whatever the number of texts; texts then take their places in
parallel by their rank in their length.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut


@dataclass(frozen=True)
class Plan:
    """configurations: (lengths with multiplicity, copies), the first `by_program` of them from the program; bound: a
    lower bound on the number of containers; program, rest: pieces placed by the program and by the largest-first rest."""

    configurations: list[tuple[dict[int, int], int]]
    containers: int
    bound: int
    by_program: int = 0
    program: int = 0
    rest: int = 0


def knapsack(capacity: int, lengths: np.ndarray, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best value, length taken or -1) for every room up to the capacity (unbounded knapsack); lengths ascending."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        k = upto[c]
        gain = best[c - lengths[:k]] + prices[:k]
        j = int(gain.argmax())
        if gain[j] > best[c - 1]:
            best[c], take[c] = gain[j], j
        else:
            best[c] = best[c - 1]
    return best, take


def configuration(take: np.ndarray, lengths: np.ndarray, room: int, first: int) -> dict[int, int]:
    """The best configuration through one length: that length and the knapsack's choice for the room left."""
    config = {first: 1}
    while room > 0:
        j = int(take[room])
        if j < 0:
            room -= 1
            continue
        config[j] = config.get(j, 0) + 1
        room -= int(lengths[j])
    return config


def solve_program(lengths: np.ndarray, n: np.ndarray, capacity: int, rounds: int, eta: float = 0.2, near: float = 0.98) -> tuple[dict[tuple, float], float]:
    """(fractional copies by configuration, lower bound) of the configuration program, by multiplicative weights.

    Round r brings every length it can to the share r / rounds of its pieces. Weights are exp(eta * lag), lag
    the share still due. Only configurations worth at least `near` of the best advance, and none beyond the
    round's share, so small lengths aren't used up early. A length whose own best configuration falls short
    grows dearer until it doesn't. Prices over the best value are feasible for the dual: their sum is a bound.
    """
    covered, dearer = np.zeros(len(n)), np.zeros(len(n))
    shares: dict[tuple, float] = {}
    bound = float((lengths * n).sum()) / capacity
    for r in range(1, rounds + 1):
        due = r / rounds
        prices = lengths * np.exp(eta * np.clip(due - covered / n, -1, 1) + dearer)
        best, take = knapsack(capacity, lengths, prices)
        bound = max(bound, float(prices @ n) / best[capacity])
        worth = prices + best[capacity - lengths]
        limit = min(1.0, (r + 1) / rounds) * n
        short = worth < near * best[capacity]
        dearer[short] += 0.02
        late = np.flatnonzero(~short & (due * n - covered > 1e-9))
        for j in late[np.lexsort((-lengths[late], -np.round(due - covered[late] / n[late], 6)))]:
            want = due * n[j] - covered[j]
            if want <= 1e-9:
                continue
            config = configuration(take, lengths, capacity - int(lengths[j]), int(j))
            i = np.fromiter(config, dtype=np.int64)
            a = np.array([config[k] for k in config], dtype=float)
            step = min(want / config[j], float(((limit[i] - covered[i]) / a).min()))
            if step > 1e-9:
                key = tuple(sorted(config.items()))
                shares[key] = shares.get(key, 0.0) + step
                covered[i] += a * step
    return shares, bound


def plan_containers(histogram: dict[int, int], capacity: int, rounds: int = 100) -> Plan:
    """Fill containers with all items of a histogram {length: count}; lengths lie in 1..capacity.

    The solution is rounded down, and once more with fractions carried to the next configuration; the better
    plan is kept, and never one with more containers than largest-first alone, which is tried as well.
    """
    items = {int(k): int(v) for k, v in histogram.items() if v > 0}
    if not items:
        return Plan([], 0, 0)
    if min(items) < 1 or max(items) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths = np.array(sorted(items))
    n = np.array([items[k] for k in lengths], dtype=float)
    shares, bound = solve_program(lengths, n, capacity, rounds)
    plans = [_finish(s, n, lengths, capacity, bound, carry) for s, carry in ((shares, True), (shares, False), ({}, False))]
    return min(plans, key=lambda p: (p.containers, p.rest))


def _finish(shares: dict[tuple, float], n: np.ndarray, lengths: np.ndarray, capacity: int, bound: float, carry: bool) -> Plan:
    """Whole copies of the fractional solution, greatest first, and the rest largest-first."""
    left = n.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []
    over = 0.0
    for key, x in sorted(shares.items(), key=lambda s: (-s[1], s[0])):
        copies = math.floor(x + over + 1e-9)
        over = x + over - copies if carry else 0.0
        copies = min([copies, *(int(left[j]) // a for j, a in key)])
        if copies > 0:
            plan.append(({int(lengths[j]): a for j, a in key}, copies))
            for j, a in key:
                left[j] -= a * copies
    rest, by_program = int(left.sum()), len(plan)
    alive = [j for j in range(len(left)) if left[j] > 0]
    sizes = [int(lengths[j]) for j in alive]
    while alive:
        room, used = capacity, {}
        top = len(alive)
        while room > 0 and top > 0:
            top = min(top, bisect.bisect_right(sizes, room))
            if not top:
                break
            j = alive[top - 1]
            a = min(int(left[j]), room // sizes[top - 1])
            used[j] = a
            room -= a * sizes[top - 1]
            top -= 1
        copies = min(int(left[j]) // a for j, a in used.items())
        plan.append(({int(lengths[j]): a for j, a in used.items()}, copies))
        for j, a in used.items():
            left[j] -= a * copies
        keep = [i for i, j in enumerate(alive) if left[j] > 0]
        alive, sizes = [alive[i] for i in keep], [sizes[i] for i in keep]
    return Plan(plan, sum(c for _, c in plan), math.ceil(bound - 1e-9), by_program, int(n.sum()) - rest, rest)


class Packed(NamedTuple):
    """placed: one row a piece; plan: the configurations it follows. Both are tables, so both can be stored and read again."""

    placed: DataFrame
    plan: DataFrame


PLAN_SCHEMA = "container_kind string, capacity_tokens long, first_container long, copies long, configuration map<int,int>, by_program boolean, least_containers long"


def pack(items: DataFrame, targets: DataFrame, *, id_col: str, size_col: str, rounds: int = 100, salts: int = 64) -> Packed:
    """Places for all items in containers of every kind of `targets` (container_kind, capacity_tokens).

    Columns of placed: container_kind, container_id, id, piece_no, start_token, n_tokens. An item longer than the capacity
    is cut into full pieces and a rest; no other item is divided. Items of NULL or no size, and ids that
    are NULL, take no place; repeated rows of an id are one item of its greatest size. Only the length
    histogram (at most one row per kind and length up to the capacity) and the plan pass the driver. Ranks
    within a length are counted in `salts` parts, so a length shared by a third of all items is spread.
    """
    spark = items.sparkSession
    sizes = items.filter(F.col(id_col).isNotNull() & (F.col(size_col) > 0)).groupBy(F.col(id_col).alias("id")).agg(F.max(size_col).cast("long").alias("size"))
    kinds = {r["container_kind"]: int(r["capacity_tokens"]) for r in targets.filter("container_kind is not null and capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()}
    dims = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("cap")) for k, c in sorted(kinds.items())])
    if not kinds:
        dims = dims.cast("array<struct<container_kind:string,cap:bigint>>")
    cuts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("cap")))
    pieces = sizes.select("id", "size", F.inline(dims)).select("container_kind", "id", F.col("size"), "cap", F.posexplode(cuts).alias("piece_no", "_k"))
    pieces = pieces.select("container_kind", "id", "piece_no", (F.col("piece_no") * F.col("cap")).cast("long").alias("start_token"), F.least(F.col("cap"), F.col("size") - F.col("piece_no") * F.col("cap")).cast("int").alias("n_tokens"))
    by = ["container_kind", "n_tokens"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece_no"), F.lit(salts)).cast("int"))
    counts = cut(salted.groupBy(*by, "salt").count())
    lengths = counts.groupBy(*by).agg(F.sum("count").alias("n")).collect()
    plans = {k: plan_containers({r["n_tokens"]: r["n"] for r in lengths if r["container_kind"] == k}, cap, rounds) for k, cap in kinds.items()}
    # per kind and length: first rank, items per container and first container of each configuration that uses it
    slots: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    for kind, plan in plans.items():
        base, used = 0, {}
        for config, copies in plan.configurations:
            for length, a in config.items():
                first = used.get(length, 0)
                slots.setdefault((kind, length), []).append((first, a, base))
                used[length] = first + a * copies
            base += copies
    shipped = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64).T for k, v in slots.items()})
    offsets = counts.select(*by, "salt", (F.sum("count").over(W.partitionBy(*by).orderBy("salt")) - F.col("count")).alias("offset"))
    within = F.row_number().over(W.partitionBy(*by, "salt").orderBy("id", "piece_no")) - 1
    ranked = salted.withColumn("r", within).join(offsets, [*by, "salt"]).select(*by, "id", "piece_no", "start_token", (F.col("r") + F.col("offset")).alias("rank"))

    def place(batches):
        for pdf in batches:
            out = np.zeros(len(pdf), dtype=np.int64)
            for (kind, length), rows in pdf.groupby(by, sort=False).indices.items():
                first, a, base = shipped.value[kind, int(length)]
                rank = pdf["rank"].to_numpy()[rows]
                i = np.searchsorted(first, rank, side="right") - 1
                out[rows] = base[i] + (rank - first[i]) // a[i]
            yield pd.DataFrame({"container_kind": pdf["container_kind"], "container_id": out, "id": pdf["id"], "piece_no": pdf["piece_no"], "start_token": pdf["start_token"], "n_tokens": pdf["n_tokens"]})

    placed = ranked.mapInPandas(place, "container_kind string, container_id long, id long, piece_no int, start_token long, n_tokens int")
    lines = []
    for kind, plan in sorted(plans.items()):
        base = 0
        for i, (config, copies) in enumerate(plan.configurations):
            lines.append((kind, kinds[kind], base, copies, config, i < plan.by_program, plan.bound))
            base += copies
    return Packed(placed, spark.createDataFrame(lines, PLAN_SCHEMA))


def packing_report(packed: Packed) -> DataFrame:
    """Per kind: containers, pieces, tokens, the fullest container, the share of space filled, the program's lower bound and the pieces placed by it and by the rest."""
    pieces = F.aggregate(F.map_values("configuration"), F.lit(0).cast("long"), lambda s, a: s + a) * F.col("copies")
    by = packed.plan.groupBy("container_kind").agg(
        F.max("capacity_tokens").alias("capacity_tokens"), F.max("least_containers").alias("least_containers"),
        F.sum(F.when(F.col("by_program"), pieces).otherwise(0)).alias("program_pieces"), F.sum(F.when(F.col("by_program"), 0).otherwise(pieces)).alias("rest_pieces"),
    )
    per = packed.placed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    total = per.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return total.join(by, "container_kind").withColumn("fill_rate", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def balance(packed: Packed, items: DataFrame, *, id_col: str, size_col: str) -> DataFrame:
    """Per kind, what a packing must satisfy: items placed, their tokens less those of the pieces, gaps or overlaps inside an item, pieces of items divided though they fit, containers over capacity."""
    sizes = items.filter(F.col(id_col).isNotNull() & (F.col(size_col) > 0)).groupBy(F.col(id_col).alias("id")).agg(F.max(size_col).cast("long").alias("size"))
    caps = packed.plan.groupBy("container_kind").agg(F.max("capacity_tokens").alias("cap"))
    per = packed.placed.groupBy("container_kind", "id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count_distinct("piece_no").alias("d"))
    one = per.join(sizes, "id", "left").join(caps, "container_kind")
    rows = one.groupBy("container_kind").agg(
        F.count("*").alias("items"), F.sum(F.coalesce("size", F.lit(0)) - F.col("t")).alias("tokens_missing"),
        F.count_if((F.col("end") != F.col("t")) | (F.col("d") != F.col("k"))).alias("broken_items"), F.count_if((F.col("k") > 1) & (F.col("size") <= F.col("cap"))).alias("divided_needlessly"),
    )
    full = packed.placed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t")).join(caps, "container_kind").groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("cap")).alias("overfull"))
    return rows.join(full, "container_kind")
