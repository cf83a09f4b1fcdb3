"""Keyed table maintenance and run metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.naming import ordered_category


def predictions_union(frames: dict[str, DataFrame], required=("site", "ts", "actual", "predicted")) -> tuple[DataFrame, DataFrame, list[str]]:
    """Union of one table per model; tables without the required columns are skipped.

    Returns the rows, the period per model with a flag whether all models cover
    the same one, and the skipped model names.
    """
    good = {m: d for m, d in frames.items() if set(required) <= set(d.columns)}
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(m).alias("model"), *required) for m, d in good.items()])
    spans = rows.groupBy("model").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    kinds = spans.agg(F.count_distinct("first_ts", "last_ts").alias("k")).select("k").scalar()
    return rows, spans.withColumn("ranges_identical", kinds == 1), [m for m in frames if m not in good]


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those with the same key, others stay; an empty new set changes nothing."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_partition_rows(existing: DataFrame, new: DataFrame, site_dim: DataFrame) -> DataFrame:
    """Selective retrain: rows of the retrained sites are swapped, cascade order restored."""
    kept = existing.join(new.select("site").distinct(), "site", "left_anti")
    return ordered_category(kept.unionByName(new), site_dim)


# Policy statements stored with every backtest.
POLICIES = {
    "split_strategy": "chronological 70/15/15",
    "outage_input_type": "last_known_outage_status_before_forecast_day",
    "hydrologic_input_type": "lagged_or_persistence_context",
    "evaluation_type": "rolling_24h_day_ahead_backtest",
}


def run_metadata(panel: DataFrame, split_days: DataFrame, stored: DataFrame, models: list[str]) -> DataFrame:
    """One row: covered period, days per split, every known model name, policies."""
    span = panel.agg(F.min("ts").alias("data_start"), F.max("ts").alias("data_end"))
    days = split_days.groupBy().pivot("split", ["validation", "testing"]).agg(F.count_distinct("d"))
    known = stored.agg(F.collect_set("model").alias("m"))
    names = F.sort_array(F.array_union(known.select("m").scalar(), F.array(*[F.lit(m) for m in models])))
    return span.select(
        "data_start", "data_end", days.select("validation").scalar().alias("validation_days"),
        days.select("testing").scalar().alias("testing_days"), F.concat_ws(",", names).alias("models"),
        *[F.lit(v).alias(k) for k, v in POLICIES.items()],
    )


def cleaning_metadata(panel: DataFrame, daily_violations: DataFrame, columns: list[str]) -> DataFrame:
    """One row about the cleaned table and the daily-value check."""
    bad = daily_violations.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return panel.agg(F.max("ts").alias("latest_timestamp"), F.count(F.lit(1)).alias("rows")).select(
        "*", F.lit(",".join(columns)).alias("columns"), bad.alias("dates_with_multiple_values"),
        (bad == 0).alias("consistency_passed"),
    )
