"""Every query with SQL agrees with DuckDB at the smallest scale."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def rows(df: pd.DataFrame):
    def plain(x):
        if x is None or x is pd.NaT or (not hasattr(x, "__len__") and pd.isna(x)):
            return None
        if hasattr(x, "item") and not hasattr(x, "__len__"):
            x = x.item()
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5) + 0.0
        return x if isinstance(x, (str, int, bool)) else str(x)

    return sorted([tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)], key=repr)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, small, con, name):
    got, want = entry.queries()[name](spark, small).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark, small):
    assert entry.entry(spark).columns == ["vintage_month", "base_month", "series", "change_kind", "old_value", "new_value"]
