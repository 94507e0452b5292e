"""Panels derived from the star-schema tables, used where an operator needs a complete month-by-asset panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.months import month_index
from ..session import cut
from .tables import table

def asset_prices(spark: SparkSession, d: str) -> DataFrame:
    """(month, ticker, px): ten assets by order priority and line status, px the mean price of a unit."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_extendedprice", "l_quantity", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    o = table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("month", F.concat("p", "l_linestatus").alias("ticker")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("px"))


def asset_returns(spark: SparkSession, d: str) -> DataFrame:
    """(month, ticker, r): next month's price over this month's, less one; none where the next month has no price.

    Built once and written, since most readers join it with itself; months times tickers rows.
    """
    w = W.partitionBy("ticker").orderBy("month")
    follows = month_index(F.lead("month").over(w)) == month_index(F.col("month")) + 1
    return cut(asset_prices(spark, d).withColumn("r", F.when(follows, F.lead("px").over(w)) / F.col("px") - 1).filter("r is not null").select("month", "ticker", "r"))


def macro_panel(spark: SparkSession, d: str) -> DataFrame:
    """(month, series, value, tcode, grp): order value by customer nation and month, with real gaps at small scale."""
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    v = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("month", F.col("c_nationkey").alias("series")).agg(F.sum("o_totalprice").alias("value"))
    v = v.join(n, F.col("series") == F.col("n_nationkey"))
    return v.select("month", "series", "value", (F.col("series") % 7 + 1).alias("tcode"), (F.col("n_regionkey") + 2).alias("grp"))


def regimes(months: DataFrame, k: int = 6) -> DataFrame:
    """(month, label): a fixed assignment of months to labels 0..k-1, for operators that need given labels."""
    mi = month_index(F.col("month"))
    return months.select("month").distinct().select("month", F.pmod(mi * 7 + F.floor(mi / 5), F.lit(k)).cast("int").alias("label"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, label): embedding vectors in double precision."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label"))
