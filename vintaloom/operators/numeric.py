"""Dense fits of bounded size, one group a call: principal components, partitions, ridge and Bayesian moments.

A group is one decision window or one regime (months x series, bounded by the calendar and the panel), so it
fits one task; groups run in parallel. Every fit is deterministic: ties and signs follow fixed rules.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


def principal_components(x: np.ndarray, threshold: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, components, explained ratios) of the fewest components that reach the threshold; each sign makes its largest loading positive."""
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    rank = min(int((s > np.finfo(float).eps * max(c.shape) * (s[0] if len(s) else 0)).sum()), len(x) - 1)
    if rank < 1:
        return np.zeros((len(x), 0)), np.zeros((0, x.shape[1])), np.zeros(0)
    ratio = s[:rank] ** 2 / (s[:rank] ** 2).sum()
    k = min(rank, int(np.searchsorted(np.cumsum(ratio), threshold - 1e-15)) + 1)
    v = vt[:k]
    v = v * np.where(v[np.arange(k), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return c @ v.T, v, ratio[:k]


def _rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _distance(x: np.ndarray, c: np.ndarray, spherical: bool) -> np.ndarray:
    return np.clip(1 - x @ c.T, 0, 2) if spherical else ((x[:, None, :] - c[None]) ** 2).sum(axis=2)


def kmeans(x: np.ndarray, k: int, spherical: bool, seed: int = 0, starts: int = 20, iterations: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, centers, objective) of the best start; clusters are numbered by the lexicographic order of their centers.

    An empty cluster takes the row explained worst. Spherical clusters compare directions.
    """
    x = _rows(x) if spherical else x
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = _distance(x, c, spherical).min(axis=1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))]])
        label = None
        for _ in range(iterations):
            d = _distance(x, c, spherical)
            new = d.argmin(axis=1)
            for j in range(k):
                if not (new == j).any():
                    new[d[np.arange(len(x)), new].argmax()] = j
            if label is not None and (new == label).all():
                break
            label = new
            c = np.array([x[label == j].mean(axis=0) for j in range(k)])
            c = _rows(c) if spherical else c
        value = float(_distance(x, c, spherical)[np.arange(len(x)), label].sum())
        order = np.lexsort(c.T[::-1])
        named = (round(value, 12), tuple(np.argsort(order)[label]))
        if best is None or named < best[0]:
            best = (named, np.argsort(order)[label], c[order], value)
    return best[1], best[2], best[3]


def two_stage_centers(x: np.ndarray, k: int = 5, seed: int = 0, starts: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labels, all centers, stage-one centers with the smaller first, spherical centers): see two_stage."""
    first, c2, _ = kmeans(x, 2, False, seed, starts)
    small = 0 if (first == 0).sum() <= (first == 1).sum() else 1
    rest = np.flatnonzero(first != small)
    inner, centers, _ = kmeans(x[rest], min(k, len(rest)), True, seed, starts)
    labels = np.zeros(len(x), dtype=int)
    labels[rest] = inner + 1
    return labels, np.vstack([c2[small], centers]), c2[[small, 1 - small]], centers


def two_stage(x: np.ndarray, k: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centers): the smaller of two Euclidean clusters is 0 (ties: first center), the rest are spherical clusters 1..k."""
    return two_stage_centers(x, k, seed)[:2]


def ridge_path(x: np.ndarray, y: np.ndarray, lambdas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, intercepts, leave-one-out mean squared errors) for every lambda from one decomposition; the intercept is free."""
    mx, my = x.mean(axis=0), y.mean()
    u, s, vt = np.linalg.svd(x - mx, full_matrices=False)
    r = y - my
    shrink = s[None] / (s[None] ** 2 + lambdas[:, None])
    coef = (shrink * (u.T @ r)[None]) @ vt
    icpt = my - coef @ mx
    hat = 1 / len(x) + (u[None] ** 2 * (s[None] * shrink)[:, None, :]).sum(axis=2)
    gap = 1 - hat
    err = y[None] - (x @ coef.T).T - icpt[:, None]
    loo = np.where(gap > 1e-8, err / np.where(gap > 1e-8, gap, 1), np.nan)
    for k, i in zip(*np.where(gap <= 1e-8)):
        keep = np.arange(len(x)) != i
        xm, ym = x[keep].mean(axis=0), y[keep].mean()
        b = np.linalg.solve((x[keep] - xm).T @ (x[keep] - xm) + lambdas[k] * np.eye(x.shape[1]), (x[keep] - xm).T @ (y[keep] - ym))
        loo[k, i] = y[i] - (ym + (x[i] - xm) @ b)
    return coef, icpt, (loo**2).mean(axis=1)


def choose_lambda(lambdas: np.ndarray, mse: np.ndarray) -> int:
    """The place of the least error; of errors within 1e-12 of it, the greatest lambda."""
    near = mse <= np.nanmin(mse) * (1 + 1e-12)
    return int(max(np.flatnonzero(near), key=lambda i: lambdas[i]))


def black_litterman(mean: np.ndarray, cov: np.ndarray, q: np.ndarray, p: np.ndarray, omega: np.ndarray, tau: float = 0.05) -> np.ndarray:
    """Posterior mean under views p m = q with error omega; the prior mean without views."""
    if not len(q):
        return mean
    t = tau * cov
    return mean + t @ p.T @ np.linalg.solve(p @ t @ p.T + omega, q - p @ mean)


def utility_direction(mean: np.ndarray, cov: np.ndarray, delta: float = 3.0) -> np.ndarray:
    return np.linalg.solve(delta * cov, mean)


def match_centers(old: np.ndarray, new: np.ndarray) -> tuple[tuple[int, ...], float]:
    """The one-to-one assignment of new to old centers of least total distance (centers are at most a handful)."""
    cost = np.sqrt(((new[:, None] - old[None]) ** 2).sum(axis=2))
    best = min(itertools.permutations(range(len(old)), len(new)), key=lambda m: (cost[np.arange(len(new)), list(m)].sum(), m))
    return best, float(cost[np.arange(len(new)), list(best)].sum())


def gaussian_mixture(x: np.ndarray, labels: np.ndarray, reg: float = 1e-6, iterations: int = 300, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(means, responsibilities) of a full-covariance mixture started from given labels, so component j stays aligned with label j."""
    k = int(labels.max()) + 1
    resp = np.eye(k)[labels]
    last = -np.inf
    for _ in range(iterations):
        n = resp.sum(axis=0) + 1e-12
        mu = resp.T @ x / n[:, None]
        logp = np.empty((len(x), k))
        for j in range(k):
            d = x - mu[j]
            cov = (resp[:, j, None] * d).T @ d / n[j] + reg * np.eye(x.shape[1])
            low = np.linalg.cholesky(cov)
            z = np.linalg.solve(low, d.T)
            logp[:, j] = np.log(n[j] / len(x)) - 0.5 * (z**2).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        top = logp.max(axis=1, keepdims=True)
        ll = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
        resp = np.exp(logp - ll[:, None])
        if abs(ll.mean() - last) < tol:
            break
        last = ll.mean()
    return mu, resp


def _matrix(pdf: pd.DataFrame, row: str, col: str, value: str) -> pd.DataFrame:
    """Rows x columns in order; an absent cell takes its column's mean, so no column and no row is lost."""
    m = pdf.pivot_table(index=row, columns=col, values=value, aggfunc="max").sort_index()
    return m.fillna(m.mean())


def window_components(panel: DataFrame, window: str, row: str = "month", col: str = "series", value: str = "z", threshold: float = 0.95) -> DataFrame:
    """(window, row, component, score, ratio): principal components of each window's columns."""
    kind = dict(panel.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf, row, col, value)
        if len(m) < 2 or not m.shape[1]:
            return pd.DataFrame({window: [], row: [], "component": [], "score": [], "ratio": []})
        scores, _, ratio = principal_components(m.to_numpy(), threshold)
        k = scores.shape[1]
        return pd.DataFrame({window: pdf[window].iloc[0], row: np.repeat(m.index, k), "component": np.tile(np.arange(k), len(m)), "score": scores.ravel(), "ratio": np.tile(ratio, len(m))})

    return panel.select(window, row, col, value).groupBy(window).applyInPandas(fit, f"`{window}` {kind[window]}, `{row}` {kind[row]}, component int, score double, ratio double")


def window_partition(scores: DataFrame, window: str, row: str = "month", k: int = 5, seed: int = 0) -> DataFrame:
    """(window, row, label): the two-stage partition of each window's rows."""
    kind = dict(scores.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf, row, "component", "score")
        labels = two_stage(m.to_numpy(), k, seed)[0] if len(m) > 1 else np.zeros(len(m), dtype=int)
        return pd.DataFrame({window: pdf[window].iloc[0], row: m.index, "label": labels})

    return scores.groupBy(window).applyInPandas(fit, f"`{window}` {kind[window]}, `{row}` {kind[row]}, label int")


def ridge_line(pairs: DataFrame, by: str, lam: float) -> DataFrame:
    """(by, n, slope, intercept, loo_mse) of one-variable ridge regression in closed form, entirely as aggregates over rows (by, x, y)."""
    g = pairs.groupBy(by).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx"))
    g = g.withColumn("slope", F.try_divide(F.col("n") * F.col("cxy"), F.col("n") * F.col("vx") + lam)).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    j = pairs.join(g, by)
    hat = 1 / F.col("n") + F.try_divide(F.pow(F.col("x") - F.col("mx"), 2), F.col("n") * F.col("vx") + lam)
    e = F.try_divide(F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"), 1 - hat)
    return j.groupBy(by, "n", "slope", "intercept").agg(F.avg(F.pow(e, 2)).alias("loo_mse"))


def lambda_grid(low: float = 1e-4, high: float = 1e4, n: int = 41) -> tuple[float, ...]:
    """Penalties evenly spaced in their logarithm."""
    return tuple(float(v) for v in np.logspace(np.log10(low), np.log10(high), n))


def ridge_line_grid(pairs: DataFrame, by: str, lambdas: tuple[float, ...]) -> DataFrame:
    """(by, lam, loo_mse) of one-variable ridge regression for every penalty, from one pass of moments and one of errors."""
    g = pairs.groupBy(by).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx"))
    j = pairs.join(g, by).withColumn("lam", F.explode(F.array(*[F.lit(v) for v in lambdas])))
    den = F.col("n") * F.col("vx") + F.col("lam")
    away = F.col("x") - F.col("mx")
    e = (F.col("y") - F.col("my") - F.col("n") * F.col("cxy") / den * away) / (1 - 1 / F.col("n") - F.pow(away, 2) / den)
    return j.groupBy(by, "lam").agg(F.avg(F.pow(e, 2)).alias("loo_mse"))


def least_error(tried: DataFrame, by: list[str], lam: str, error: str, rtol: float = 1e-12) -> DataFrame:
    """(by, lam): the penalty of least error; of errors within rtol of it, the greatest penalty. NULL errors can't be chosen."""
    least = F.min(error).over(W.partitionBy(*by))
    return tried.withColumn("_m", least).filter(F.col(error) <= F.col("_m") * (1 + rtol)).groupBy(*by).agg(F.max(lam).alias(lam))


def require_spd(m: np.ndarray, rtol: float = 1e-12) -> np.ndarray:
    """m itself if it is finite, square, symmetric and positive definite; ValueError otherwise."""
    m = np.asarray(m, dtype=float)
    if m.ndim != 2 or m.shape[0] != m.shape[1] or not np.isfinite(m).all() or not np.allclose(m, m.T, rtol=rtol, atol=0):
        raise ValueError("not a finite symmetric matrix")
    try:
        np.linalg.cholesky(m)
    except np.linalg.LinAlgError as e:
        raise ValueError("not positive definite") from e
    return m


def require_probabilities(p: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """p itself if it is a vector of finite numbers not below 0 that sum to 1; ValueError otherwise."""
    p = np.asarray(p, dtype=float)
    if p.ndim != 1 or not np.isfinite(p).all() or (p < 0).any() or abs(p.sum() - 1) > tol:
        raise ValueError("not probabilities")
    return p


def aligned(values: dict, names: list) -> np.ndarray:
    """The values in the order of names; ValueError unless the keys are exactly these and all values finite."""
    if set(values) != set(names) or len(set(names)) != len(names):
        raise ValueError("names differ")
    out = np.array([float(values[n]) for n in names])
    if not np.isfinite(out).all():
        raise ValueError("a value isn't finite")
    return out
