"""Accuracy metrics, model comparison and forecast summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import cumulative_counts, exact_quantiles, mae, metric_columns, operational_mape, operational_threshold, rmse

NAMES = ["operational_mape", "mae", "rmse", "r2"]


def forecast_metrics(p: DataFrame, keys=("model", "site", "split")) -> DataFrame:
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *metric_columns())


def mape_coverage(p: DataFrame, keys=("model", "site")) -> DataFrame:
    """Rows inside and outside the percentage error, and the low-load flag."""
    inside = F.abs("actual") >= operational_threshold("capacity")
    frac = F.try_divide(F.count_if(~inside), F.count(F.lit(1)))
    return p.groupBy(*keys).agg(
        F.count_distinct("forecast_date").alias("forecast_days"), F.count(F.lit(1)).alias("forecast_hours"),
        F.count_if(inside).alias("rows_included"), F.count_if(~inside).alias("rows_excluded"),
        frac.alias("excluded_fraction"), (frac > S.LOW_LOAD_FRACTION).alias("low_load_regime"),
    )


def daily_metrics(p: DataFrame, keys=("model", "site", "forecast_date")) -> DataFrame:
    return p.groupBy(*keys).agg(
        operational_mape("actual", "predicted", "capacity").alias("operational_mape"), mae("actual", "predicted").alias("mae"),
        rmse("actual", "predicted").alias("rmse"), F.count(F.lit(1)).alias("samples"),
    )


def _ape() -> Column:
    return F.abs(F.col("actual") - F.col("predicted")) / F.greatest(F.abs("actual"), F.lit(1e-6)) * 100.0


def shape_metrics(p: DataFrame, keys=("model", "site", "split"), ts: str = "ts") -> DataFrame:
    """How well the forecast follows ups and downs, besides point errors."""
    w = Window.partitionBy(*keys).orderBy(ts)
    d = p.select(
        *keys, _ape().alias("ape"), (F.col("actual") - F.lag("actual").over(w)).alias("da"),
        (F.col("predicted") - F.lag("predicted").over(w)).alias("dp"),
    )
    return d.groupBy(*keys).agg(
        F.avg("ape").alias("shape_mape"), F.count_if(F.col("ape") <= 3.0).alias("ape_le_3_count"), F.max("ape").alias("max_ape"),
        F.avg(F.when(F.signum("da") == F.signum("dp"), 1.0).when(F.col("da").isNotNull(), 0.0)).alias("trend_match_rate"),
        F.avg(F.abs(F.col("da") - F.col("dp"))).alias("delta_mae"),
    )


def plain_mape(p: DataFrame, keys=("model", "site")) -> DataFrame:
    hit = F.abs("actual") > 0
    return p.groupBy(*keys).agg(
        (F.avg(F.when(hit, F.abs((F.col("actual") - F.col("predicted")) / F.nullif("actual", F.lit(0.0))))) * 100.0).alias("mape")
    )


def day_diagnostics(actual: DataFrame, forecast: DataFrame, keys=("site", "hour")) -> DataFrame:
    """Hour-aligned errors: (model, site, hour), or with the day among ``keys`` of any number of days."""
    both = actual.join(forecast, list(keys))
    return both.select("model", *keys, "actual", "predicted", F.abs(F.col("actual") - F.col("predicted")).alias("absolute_error"), _ape().alias("ape"))


def day_diagnostics_summary(detail: DataFrame, keys=("model", "site")) -> DataFrame:
    shape = shape_metrics(detail, keys, "hour")
    basic = detail.groupBy(*keys).agg(mae("actual", "predicted").alias("mae"), rmse("actual", "predicted").alias("rmse"))
    return shape.join(basic, list(keys))


# --- comparing models ------------------------------------------------------

def val_test_summary(metrics: DataFrame, feature_counts: DataFrame) -> DataFrame:
    """Validation next to testing; a conditional aggregate instead of a self-join."""
    side = lambda split, p: [F.max(F.when(F.col("split") == split, F.col(n))).alias(f"{p}_{n}") for n in NAMES]
    both = metrics.groupBy("model", "site").agg(
        F.count_distinct(F.when(F.col("split").isin("validation", "testing"), F.col("split"))).alias("_k"),
        *side("validation", "val"), *side("testing", "test"),
    )
    return both.where("_k = 2").drop("_k").join(feature_counts, "site", "left").withColumn("feature_count", F.coalesce("feature_count", F.lit(0)))


def model_leaderboard(metrics: DataFrame, site_dim: DataFrame) -> DataFrame:
    """Models ranked within each site, sites in cascade order."""
    w = Window.partitionBy("site").orderBy("operational_mape", "model")
    return metrics.withColumn("rank", F.row_number().over(w)).join(site_dim.select("site", "ordinal"), "site")


def best_model(metrics: DataFrame) -> DataFrame:
    best = F.min(F.struct("operational_mape", "model", "mae", "rmse", "r2")).alias("b")
    return metrics.groupBy("site").agg(best).select(
        "site", F.col("b.model").alias("best_model"), *[F.col(f"b.{n}").alias(f"testing_{n}") for n in NAMES]
    )


def head_to_head(metrics: DataFrame, primary: str) -> DataFrame:
    """The primary model against each rival per site; a higher R2 wins."""
    own = metrics.where(F.col("model") == primary).select("site", *[F.col(n).alias(f"primary_{n}") for n in NAMES])
    rival = metrics.where(F.col("model") != primary).select("site", F.col("model").alias("rival"), *[F.col(n).alias(f"rival_{n}") for n in NAMES])
    won = lambda n: (F.col(f"primary_{n}") > F.col(f"rival_{n}")) if n == "r2" else (F.col(f"primary_{n}") < F.col(f"rival_{n}"))
    return own.join(rival, "site").select("*", *[won(n).alias(f"won_{n}") for n in NAMES])


# --- error distributions ---------------------------------------------------

def residual_histogram(p: DataFrame, bins: int = 60, keys=("model",)) -> DataFrame:
    """Equal-width bins of actual - predicted for each of ``keys``; the last one includes its edge."""
    r = p.select(*keys, (F.col("actual") - F.col("predicted")).alias("r"))
    ends = r.groupBy(*keys).agg(F.struct(F.min("r").alias("lo"), F.max("r").alias("hi")).alias("e"))
    lo, hi = F.col("e.lo"), F.col("e.hi")
    place = F.floor(F.coalesce(F.try_divide((F.col("r") - lo) * bins, hi - lo), F.lit(0.0)))
    counted = r.join(ends, list(keys)).groupBy(*keys, F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("e").alias("e")
    )
    edge = lambda i: lo + i * (hi - lo) / bins
    return counted.select(*keys, "bin", "n", edge(F.col("bin")).alias("bin_from"), edge(F.col("bin") + 1).alias("bin_to"))


def scatter_extent(p: DataFrame, keys=("model",)) -> DataFrame:
    return p.groupBy(*keys).agg(
        F.min(F.least("actual", "predicted")).alias("low"), F.max(F.greatest("actual", "predicted")).alias("high")
    )


def error_values(p: DataFrame, percentage: bool = False) -> DataFrame:
    """``error_value`` per row: absolute, or in percent on operational rows."""
    e = F.abs(F.col("actual") - F.col("predicted"))
    if not percentage:
        return p.withColumn("error_value", e).where("error_value is not null")
    keep = (F.abs("actual") >= operational_threshold("capacity")) & (F.abs("actual") > 0)
    return p.where(keep).withColumn("error_value", e / F.abs("actual") * 100.0)


BLOCK = 4096


def error_cdf(errors: DataFrame, keys=("model",)) -> DataFrame:
    """One row per observation: sorted error and rank / n.

    A model may own a third of all rows, so ranks come from ranges of values (see
    ``cumulative_counts``) rather than from one sorted partition per model, and
    a value repeated very often is expanded in blocks spread over the cluster.
    """
    keys = list(keys)
    ranked = cumulative_counts(errors, keys, "error_value")
    step = F.lit(BLOCK).cast("bigint")
    few = ranked.where(F.col("n") <= BLOCK).withColumn("_first", F.col("before")).withColumn("_len", F.col("n"))
    many = (
        ranked.where(F.col("n") > BLOCK)
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / step))))
        .withColumn("_first", F.col("before") + F.col("_b") * step)
        .withColumn("_len", F.least(step, F.col("n") - F.col("_b") * step))
        .repartition(*keys, "error_value", "_b")
        .drop("_b")
    )
    every = few.unionByName(many).withColumn("rank", F.explode(F.sequence(F.col("_first") + 1, F.col("_first") + F.col("_len"))))
    return every.select(*keys, "error_value", (F.col("rank") / F.col("total")).alias("cdf_probability"), F.col("total").alias("observations"))


def error_quantiles(errors: DataFrame, keys=("model",)) -> DataFrame:
    keys = list(keys)
    share = lambda t: (F.avg(F.when(F.col("error_value") <= t, 1.0).otherwise(0.0)) * 100.0).alias(f"within_{t}")
    basic = errors.groupBy(*keys).agg(F.count("error_value").alias("n"), share(5), share(10))
    q = exact_quantiles(errors, keys, "error_value", {"median": 0.5, "p80": 0.8, "p90": 0.9, "p95": 0.95})
    return basic.join(q, keys)


# --- forecast summaries ----------------------------------------------------

def cascade_series(forecast: DataFrame, keys=("model",)) -> DataFrame:
    return forecast.groupBy(*keys, "forecast_hour").agg(F.sum("mw").alias("mw"))


def _extreme_hour(pick: str) -> Column:
    """Hour of the first maximum or minimum."""
    if pick == "max":
        return F.max_by("forecast_hour", F.struct("mw", -F.col("forecast_hour")))
    return F.min_by("forecast_hour", F.struct("mw", "forecast_hour"))


def forecast_kpis(forecast: DataFrame, plan_summary: DataFrame, keys=("forecast_date", "model")) -> DataFrame:
    """Cascade energy and peak per day and model, with the sites under outage that day.

    ``plan_summary`` has a row per ``forecast_date``.
    """
    kpi = cascade_series(forecast, keys).groupBy(*keys).agg(F.sum("mw").alias("cascade_energy"), F.max("mw").alias("peak"))
    sites = plan_summary.select("forecast_date", F.nullif("sites", F.lit("")).alias("s"))
    return kpi.join(sites, "forecast_date", "left").withColumn("affected", F.coalesce("s", F.lit("None"))).drop("s")


def series_summary(forecast: DataFrame, keys=("model", "site")) -> DataFrame:
    """Minimum, maximum, mean, first peak hour and energy of each series."""
    return forecast.groupBy(*keys).agg(
        F.min("mw").alias("minimum"), F.max("mw").alias("maximum"), F.avg("mw").alias("average"),
        _extreme_hour("max").alias("peak_hour"), F.sum("mw").alias("energy"),
    )


def cascade_comparison(forecast: DataFrame, keys=("model",)) -> DataFrame:
    return cascade_series(forecast, keys).groupBy(*keys).agg(
        F.avg("mw").alias("mean"), F.min("mw").alias("minimum"), F.max("mw").alias("maximum"),
        _extreme_hour("max").alias("peak_hour"), _extreme_hour("min").alias("lowest_hour"),
    )


def pairwise_difference(series: DataFrame, models: list[str], keys=()) -> DataFrame:
    """Mean absolute difference per model pair (and ``keys``, such as the day), from one pivoted row per hour."""
    wide = series.groupBy(*keys, "forecast_hour").agg(*[F.max(F.when(F.col("model") == m, F.col("mw"))).alias(m) for m in models])
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    means = wide.groupBy(*keys).agg(*[F.avg(F.abs(F.col(a) - F.col(b))).alias(f"{a} vs {b}") for a, b in pairs])
    return means.unpivot([*keys], [f"{a} vs {b}" for a, b in pairs], "model_pair", "mean_abs_difference").where("mean_abs_difference is not null")


def model_spread(series: DataFrame, keys=()) -> DataFrame:
    return series.groupBy(*keys, "forecast_hour").agg(F.min("mw").alias("lowest"), F.max("mw").alias("highest"))


def latest_timestamp(df: DataFrame) -> DataFrame:
    """Latest readable date over the columns named like one.

    Without such a name, every column counts in which at least three values
    and a fifth of all rows can be read.
    """
    parse = lambda c: F.col(c).cast("string").try_cast("timestamp_ntz")
    named = [c for c in df.columns if "date" in c.lower() or "time" in c.lower()]
    if named:
        best = [F.max(parse(c)) for c in named]
    else:
        enough = lambda c: F.count(parse(c)) >= F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) * 0.2))
        best = [F.when(enough(c), F.max(parse(c))) for c in df.columns]
    return df.agg((F.greatest(*best) if len(best) > 1 else best[0]).alias("latest"))
