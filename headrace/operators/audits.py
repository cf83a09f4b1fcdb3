"""Leak checks and reports about what was trained and selected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S


def leakage_audit(features: DataFrame, keys=("site",), name: str = "feature") -> DataFrame:
    """PASS or FAIL per key from the feature names, and over everything."""
    bad = F.col(name).rlike("(?i)" + "|".join(S.FORBIDDEN_FEATURES))
    per = features.groupBy(*keys).agg(
        F.count_distinct(name).alias("feature_count"),
        F.array_join(F.sort_array(F.collect_set(F.when(bad, F.col(name)))), ",").alias("forbidden"),
    )
    verdict = F.when(F.col("forbidden") == "", "PASS").otherwise("FAIL")
    overall = features.agg(F.when(F.bool_or(bad), "FAIL").otherwise("PASS").alias("o")).select("o").scalar()
    return per.select(*keys, "feature_count", "forbidden", verdict.alias("leakage_check"), overall.alias("overall"))


def leakage_data_check(known: DataFrame, ts: str = "ts_known", origin: str = "origin", keys=("site",)) -> DataFrame:
    """Data-level check: every feature time lies before its origin."""
    return known.groupBy(*keys).agg(
        F.max(ts).alias("latest_feature_ts"), F.count_if(F.col(ts) >= F.col(origin)).alias("violations"), F.count(F.lit(1)).alias("rows")
    )


def fairness_audit(metrics: DataFrame, audit: DataFrame) -> DataFrame:
    """Every model saw the same features, split and information."""
    return metrics.select("model", "site").distinct().join(audit.select("site", "feature_count", "leakage_check"), "site").select(
        "model", "site", "feature_count", F.lit("chronological 70/15/15").alias("split_strategy"),
        F.lit("training set only").alias("scaler_fitting"), F.lit("validation set only").alias("calibration_selection"),
        F.lit("final evaluation only").alias("testing_use"), "leakage_check",
    )


def calibration_report(shrink: DataFrame, bins: DataFrame, hourly: DataFrame, profile: DataFrame, ramps: DataFrame) -> DataFrame:
    """Which steps were accepted for each site."""
    used = lambda df, c, n: df.select("site", F.col(c).isNotNull().alias(n))
    return (
        shrink.select("site", "shrinkage", "bias")
        .join(used(bins, "scale", "bins_used"), "site").join(used(hourly, "scale", "hourly_used"), "site")
        .join(used(profile, "blend_weight", "blend_used"), "site").join(ramps.select("site", "ramp"), "site")
        .withColumn("derived_from", F.lit("validation")).withColumn("testing_used", F.lit(False))
    )


def selection_audit(summary: DataFrame, report: DataFrame) -> DataFrame:
    """Chosen calibration next to validation and testing scores."""
    return summary.join(report.drop("derived_from", "testing_used"), "site")


def feature_drift_warning(saved: DataFrame, context: DataFrame, channel: str = "rain", offsets=S.HYDRO_LAGS) -> DataFrame:
    """Lag features a saved model lacks although the panel has the channel.

    saved: site, feature; context: site and ``channel`` readings.
    """
    expected = context.where(F.col(channel).isNotNull()).select("site").distinct().select(
        "site", F.explode(F.array(*[F.lit(f"{channel}_lag{n}") for n in offsets])).alias("feature")
    )
    return expected.join(saved.select("site", "feature"), ["site", "feature"], "left_anti")
