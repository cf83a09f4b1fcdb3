"""Baseline forecasts that need no model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import series_window


def persistence(value: str, keys: list[str], ts: str = "ts"):
    """Last value before the forecast day, repeated over its hours.

    On a complete hourly grid that is the 23 h reading among the previous 24
    rows, so a bounded frame is enough.
    """
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-24, -1)
    return F.last(F.when(F.hour(ts) == 23, F.col(value)), True).over(w)


def seasonal_naive(value: str, keys: list[str], hours: int, ts: str = "ts"):
    """The value ``hours`` earlier (24: yesterday, 168: last week)."""
    return F.lag(value, hours).over(series_window(keys, ts))


def baseline_predictions(site_series: DataFrame, keys: list[str], value: str = "total", ts: str = "ts") -> DataFrame:
    """Three baseline forecasts in long form, computed in one pass over windows."""
    wide = site_series.select(
        *keys, ts, F.col(value).alias("actual"),
        persistence(value, keys, ts).alias("persistence"),
        seasonal_naive(value, keys, 24, ts).alias("naive24"),
        seasonal_naive(value, keys, 168, ts).alias("naive168"),
    )
    names = ["persistence", "naive24", "naive168"]
    return wide.unpivot([*keys, ts, "actual"], names, "model", "predicted").where("predicted is not null")
