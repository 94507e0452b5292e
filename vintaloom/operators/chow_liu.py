"""Filling missing values from similar records with a Chow-Liu dependency tree.

The tree is fitted to discretised and categorical fields: pairwise contingency tables are counted in one
aggregation whose result is bounded by the number of states, the maximum mutual-information spanning tree
is found on the driver, and the posterior of a missing field is computed by message passing toward it.
A numeric field is decoded to the median of the most probable bin, a categorical one to its mode.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class ChowLiuTree:
    """A fitted tree: states per field, edges (parent, child) with joint tables, single-field tables."""

    names: tuple[str, ...]
    cards: tuple[int, ...]
    joints: dict[tuple[int, int], np.ndarray]
    singles: tuple[np.ndarray, ...]

    def neighbours(self, i: int) -> list[int]:
        return [b if a == i else a for a, b in self.joints if i in (a, b)]

    def conditional(self, child: int, given: int) -> np.ndarray:
        """P(child | given) as a matrix given x child."""
        j = self.joints[given, child] if (given, child) in self.joints else self.joints[child, given].T
        return j / j.sum(axis=1, keepdims=True)

    def posterior(self, codes: np.ndarray, target: int) -> np.ndarray:
        """P(target | all other observed fields) per row; code -1 means not observed."""

        def message(node: int, to: int) -> np.ndarray:
            belief = evidence(node)
            for n in self.neighbours(node):
                if n != to:
                    belief = belief * message(n, node)
            m = belief @ self.conditional(node, to).T
            return m / np.maximum(m.max(axis=1, keepdims=True), 1e-300)

        def evidence(node: int) -> np.ndarray:
            seen = codes[:, node]
            e = np.ones((len(codes), self.cards[node]))
            known = seen >= 0
            e[known] = 0.0
            e[known, seen[known]] = 1.0
            return e

        p = np.tile(self.singles[target], (len(codes), 1))
        for n in self.neighbours(target):
            p = p * message(n, target)
        total = p.sum(axis=1, keepdims=True)
        return np.where(total > 0, p / np.where(total > 0, total, 1), self.singles[target])


def fit_tree(coded: DataFrame, names: Sequence[str], cards: Sequence[int], smoothing: float = 0.5) -> ChowLiuTree:
    """Fit the tree to integer code columns (NULL or -1: missing; a pair counts where both are observed).

    Every row counts. Each task counts all contingency tables in one pass over its Arrow batches; what is
    shuffled and reaches the driver is at most the sum of cards[i] * cards[j] cells a task, whatever the number
    of rows. An empty table gives a tree of uniform tables.
    """
    names, cards = tuple(names), tuple(int(c) for c in cards)
    m, width = len(names), max(cards) + 1
    pairs = [(i, j) for i in range(m) for j in range(i + 1, m)]

    def count(batches):
        seen = np.zeros((len(pairs), width * width), dtype=np.int64)
        for pdf in batches:
            codes = pdf.fillna(-1).to_numpy(dtype=np.int64)
            for k, (i, j) in enumerate(pairs):
                both = (codes[:, i] >= 0) & (codes[:, j] >= 0)
                seen[k] += np.bincount(codes[both, i] * width + codes[both, j], minlength=width * width)
        (cell,) = np.nonzero(seen.ravel())
        yield pd.DataFrame({"cell": cell, "n": seen.ravel()[cell]})

    counted = coded.select(*names).mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    tables = [np.full((cards[i], cards[j]), smoothing / (cards[i] * cards[j])) for i, j in pairs]
    for cell, n in counted:
        k, rest = divmod(cell, width * width)
        tables[k][divmod(rest, width)] += n
    tables = [t / t.sum() for t in tables]
    info = [float((t * np.log(t / (t.sum(1, keepdims=True) * t.sum(0, keepdims=True)))).sum()) for t in tables]
    group = list(range(m))
    joints = {}
    for k in sorted(range(len(pairs)), key=lambda k: (-info[k], pairs[k])):
        i, j = pairs[k]
        if group[i] != group[j]:
            joints[i, j] = tables[k]
            group = [group[i] if g == group[j] else g for g in group]
    singles = []
    for i in range(m):
        of = [tables[k].sum(1) if pairs[k][0] == i else tables[k].sum(0) for k in range(len(pairs)) if i in pairs[k]]
        singles.append(np.mean(of, axis=0) if of else np.full(cards[i], 1 / cards[i]))
    return ChowLiuTree(names, cards, joints, tuple(singles))


def posterior_modes(coded: DataFrame, tree: ChowLiuTree, targets: Sequence[str]) -> DataFrame:
    """Add <target>_mode (INT) and <target>_prob (DOUBLE): the most probable state of each target given the
    row's other observed fields. Runs in Arrow batches; the tree (a few kB) travels with the function."""
    names = list(tree.names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    schema += "".join(f", `{t}_mode` int, `{t}_prob` double" for t in targets)

    def run(batches):
        for pdf in batches:
            codes = pdf[names].fillna(-1).to_numpy(dtype=np.int64)
            for t in targets:
                k = names.index(t)
                hidden = codes.copy()
                hidden[:, k] = -1
                p = tree.posterior(hidden, k) if len(codes) else np.zeros((0, tree.cards[k]))
                pdf[f"{t}_mode"] = p.argmax(axis=1).astype("int32")
                pdf[f"{t}_prob"] = p.max(axis=1)
            yield pdf

    return coded.mapInPandas(run, schema)
