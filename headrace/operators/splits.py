"""Chronological splits and the choice of origin days."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S


def chronological_split(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Label rows train / validation / testing by position within each series.

    The ratios count as decimals: 70 % of 720 rows are 504, where doubles give 503.
    """
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(ts)) - 1, F.count(F.lit(1)).over(w)
    train, validation = Decimal(str(S.TRAIN_RATIO)), Decimal(str(S.VALIDATION_RATIO))
    first, second = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + validation))
    label = F.when(i < first, "train").when(i < second, "validation").otherwise("testing")
    return df.withColumn("split", label)


def cut_split(ts, validation_from, testing_from):
    """One cut timestamp per boundary, the same for training and backtests."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.when(ts < validation_from, "train").when(ts < testing_from, "validation").otherwise("testing")


def full_days(df: DataFrame, ts: str = "ts", keys: tuple = ()) -> DataFrame:
    """Days on which all 24 hours are present."""
    return (
        df.groupBy(*keys, F.to_date(ts).alias("d")).agg(F.count_distinct(ts).alias("n")).where(f"n = {S.HORIZON}").drop("n")
    )


def backtest_days(split_rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Full days that lie wholly inside one split and have some history."""
    first = split_rows.agg(F.min(ts).alias("m")).select("m").scalar()
    return (
        split_rows.groupBy(F.to_date(ts).alias("d"), "split")
        .agg(F.count_distinct(ts).alias("n"))
        .where((F.col("n") == S.HORIZON) & (F.col("split") != "train") & (F.col("d").cast("timestamp_ntz") > first))
        .select("d", "split")
    )


def sample_days(days: DataFrame, keys: list[str], limit: int = S.SELECTION_DAYS, day: str = "d") -> DataFrame:
    """At most ``limit`` evenly spaced days; positions round half to even."""
    w = Window.partitionBy(*keys)
    ranked = days.withColumn("_i", F.row_number().over(w.orderBy(day)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    stops = F.transform(
        F.sequence(F.lit(0), F.lit(limit - 1)),
        lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(float(limit - 1)), 0).cast("int"),
    )
    return ranked.where((F.col("_n") <= limit) | F.array_contains(stops, F.col("_i"))).drop("_i", "_n")
