"""Queries without SQL read the whole panels."""

from pyspark.sql import functions as F

from vintaloom.plans import models
from vintaloom.sources import views


def test_forecasts_use_every_series_and_month(spark, small):
    panel = views.macro_panel(spark, small)
    n, months = panel.select("series").distinct().count(), panel.select("month").distinct().count()
    x = models._features(spark, small)
    assert (x.select("series").distinct().count(), x.select("base_month").distinct().count()) == (n, months)
    assert models.window_forecasts(spark, small).select("decision_month").distinct().count() > 20


def test_returns_cover_every_month(spark, small):
    ship = views.table(spark, small, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("m")).agg(F.min("m"), F.max("m")).collect()[0]
    px = views.asset_prices(spark, small).agg(F.min("month"), F.max("month")).collect()[0]
    assert tuple(px) == tuple(ship) == ("1995-01", "2001-11")
    first = models._windows(spark, small).agg(F.min("decision_month"), F.min("month")).collect()[0]
    assert tuple(first) == ("1999-02", "1995-01")
