"""Array functions on DOUBLE vectors, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: a lambda would otherwise repeat an outer expression for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, t: s + t)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, t: s + t * t))


def largest(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, t: F.greatest(s, F.abs(t)))


def unit(a: Column) -> Column:
    """Length one, safe from overflow; a zero vector stays zero."""

    def scaled(v: Column, by: Column) -> Column:
        return let(F.when(by == 0, 1.0).otherwise(by), lambda d: F.transform(v, lambda t: t / d))

    return let(let(a, lambda v: scaled(v, largest(v))), lambda v: scaled(v, norm(v)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine within [0, 2] of two unit or zero vectors; two zero vectors have distance 0, one zero vector 1."""
    za, zb = largest(a) == 0, largest(b) == 0
    d = F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b)))
    return F.when(za & zb, 0.0).when(za | zb, 1.0).otherwise(d)


def distance_probabilities(d: Column) -> Column:
    """(1 - d_k / sum d) / (K - 1) for an array of distances; uniform where all are zero."""
    share = lambda v, s: F.when(s == 0, F.transform(v, lambda _: 1 / F.size(v))).otherwise(F.transform(v, lambda t: (1 - t / F.when(s == 0, 1.0).otherwise(s)) / (F.size(v) - 1)))
    return let(d, lambda v: let(total(v), lambda s: share(v, s)))


def combine_probabilities(p0: Column, normal: Column) -> Column:
    """[q0, *normal] normalised, q0 = -max(normal) * log2(1 - p0); [1, 0, ...] for p0 = 1."""

    def mixed(p: Column, v: Column) -> Column:
        q0 = -F.array_max(v) * F.log1p(-F.when(p < 1, p).otherwise(0.0)) / F.log(F.lit(2.0))
        joined = let(q0, lambda q: let(q + total(v), lambda mass: F.transform(F.concat(F.array(q), v), lambda t: t / mass)))
        return F.when(p >= 1, F.concat(F.array(F.lit(1.0)), F.transform(v, lambda _: F.lit(0.0)))).otherwise(joined)

    return let(normal, lambda v: let(p0, lambda p: mixed(p, v)))
