"""Calendar-month arithmetic on 'yyyy-MM' strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONTH_PATTERN = r"^\d{4}-(0[1-9]|1[0-2])$"


def is_month(m: Column) -> Column:
    """True for a well-formed month literal, false for NULL or anything else."""
    return F.coalesce(m.rlike(MONTH_PATTERN), F.lit(False))


def month_index(m: Column) -> Column:
    """Months since year 0; NULL for a malformed or absent month."""
    return F.when(is_month(m), F.substring(m, 1, 4).try_cast("int") * 12 + F.substring(m, 6, 2).try_cast("int") - 1)


def index_month(i: Column) -> Column:
    """The inverse of month_index; NULL for NULL."""
    return F.when(i.isNotNull(), F.format_string("%04d-%02d", F.floor(i / 12).cast("int"), (F.pmod(i, F.lit(12)) + 1).cast("int")))


def add_month(m: Column, k: int | Column) -> Column:
    """The month k months after m."""
    return index_month(month_index(m) + (F.lit(k) if isinstance(k, int) else k))


def month_range(a: Column, b: Column) -> Column:
    """All months from a to b, both included, as an array; empty when b is before a."""
    ia, ib = month_index(a), month_index(b)
    return F.when(ib >= ia, F.transform(F.sequence(ia, ib), index_month)).otherwise(F.array().cast("array<string>"))
