"""Leakage-safe 24-step forecasts for many (cascade, origin day) pairs at once.

One state row per (cascade, origin) carries everything a rollout needs: the
last 240 hours per site, unit histories, plans, model and calibration. States
are built with joins and windows over day-arrays; an Arrow kernel then runs the
24 steps for whole batches of states. Sites of one cascade are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import add_hours
from ..functions.rollout_kernel import batches, tree_group
from ..functions.tree_kernel import ARRAYS
from ..session import cut_lineage
from .outage import array_median
from .slices import at_hour, daily_arrays, with_origin_days

RESULT = (
    "cascade string, origin timestamp_ntz, site string, h int, base_prediction double, predicted double, "
    "units array<string>, unit_mw array<double>"
)
NO_MODEL = {
    "coef": "array<double>", "centers": "array<double>", "mean": "array<double>", "std": "array<double>", "gamma": "double",
}
NO_CALIBRATION = {
    "shrinkage": "double", "bias": "double", "bin_scale": "double", "bin_edges": "array<double>", "bin_shifts": "map<int,double>", "bin_basis": "string",
    "hour_scale": "double", "hour_shift": "array<double>", "blend_weight": "double", "anchor_weight": "double", "anchor_current": "double", "ramp": "double",
}


def whole_cascade(site_dim: DataFrame) -> DataFrame:
    """Every site in the cascade it belongs to, named by its uppermost site; all of them forecast.

    Each round doubles how far up a site looks, so a chain of n sites takes
    log2(n) rounds over the table of sites. A site whose upstream one is unknown
    is an uppermost one.
    """
    top = cut_lineage(site_dim.alias("s").join(site_dim.select(F.col("site").alias("u")), F.col("s.upstream_site") == F.col("u"), "left").select("site", F.coalesce("u", "site").alias("top")))
    for _ in range(32):
        above = top.select(F.col("site").alias("top"), F.col("top").alias("next"))
        further = cut_lineage(top.join(above, "top").select("site", F.col("next").alias("top"), (F.col("next") != F.col("top")).alias("moved")))
        top = further.select("site", "top")
        if further.where("moved").isEmpty():
            break
    else:
        raise ValueError("the sites' upstream links form a circle")
    return site_dim.join(top, "site").select(F.col("top").alias("cascade"), "site", "upstream_site", "capacity", F.lit(True).alias("live"))


def single_sites(site_dim: DataFrame) -> DataFrame:
    """One cascade per site: itself forecast, its upstream held at the last row."""
    own = site_dim.select(F.col("site").alias("cascade"), "site", "upstream_site", "capacity", F.lit(True).alias("live"))
    caps = site_dim.select(F.col("site").alias("upstream_site"), F.col("capacity").alias("up_capacity"))
    held = site_dim.join(caps, "upstream_site").select(
        F.col("site").alias("cascade"), F.col("upstream_site").alias("site"), F.lit(None).cast("string").alias("upstream_site"),
        F.col("up_capacity").alias("capacity"), F.lit(False).alias("live"),
    )
    return own.unionByName(held)


def unit_states(units: DataFrame, unit_dim: DataFrame, plan: DataFrame, origins: DataFrame) -> DataFrame:
    """Per (site, origin): the units with histories, same-hour medians and plan."""
    peers = Window.partitionBy("site", "ts")
    total = F.sum(F.coalesce("mw", F.lit(0.0)).cast("decimal(18,6)")).over(peers).cast("double")
    share = F.try_divide(F.greatest("mw", F.lit(0.0)), F.nullif(total, F.lit(0.0)))
    cells = F.sort_array(F.collect_list(F.struct(F.hour("ts").alias("h"), "mw", "share", "available")))
    daily = units.withColumn("share", share).groupBy("site", "unit", F.to_date("ts").alias("d")).agg(cells.alias("c"))
    daily = with_origin_days(daily, ["site", "unit"], origins)
    w = Window.partitionBy("site", "unit").orderBy("d")
    back = lambda n: F.collect_list("c").over(w.rowsBetween(-n, -1))
    recent, days = F.flatten(back(S.RECENT_SHARE_HOURS // 24)), back(S.SAME_HOUR_SHARES)
    # Origins are marked first, so the long arrays live on origin days only and
    # are reduced to medians in the stage that builds them.
    wanted = origins.select(F.to_date("origin").alias("d")).distinct().withColumn("_o", F.lit(True))
    state = (
        daily.join(wanted, "d", "left")
        .select("site", "unit", F.col("d").cast("timestamp_ntz").alias("origin"), "_o", recent.alias("_r"), days.alias("_d"))
        .where(F.col("_o") & (F.size("_r") > 0))
        .select(
            "site", "unit", "origin", F.transform("_r", lambda c: c["mw"]).alias("history"),
            F.element_at("_r", -1)["available"].alias("status"),
            F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: array_median(F.transform("_d", lambda c: at_hour(c, h)["share"]))).alias("hour_median"),
        )
    )
    plans = plan.groupBy("site", "unit", "origin").agg(F.sort_array(F.collect_list(F.struct("ts", "available"))).alias("p"))
    full = state.join(unit_dim, ["site", "unit"]).join(plans, ["site", "unit", "origin"], "left")
    one = F.struct("unit", "capacity", "history", "status", "hour_median",
                   F.coalesce(F.transform("p", lambda x: x["available"]), F.array_repeat(F.lit(1), S.HORIZON)).alias("plan"))
    return full.groupBy("site", "origin").agg(F.collect_list(one).alias("units"))


def _with(df: DataFrame, extra: DataFrame | None, columns: dict[str, str], keys: list[str]) -> DataFrame:
    if extra is None:
        return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})
    lacking = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in extra.columns}
    return df.join(extra.withColumns(lacking).select(*keys, *columns), keys, "left")


def states(
    members: DataFrame, series: DataFrame, units: DataFrame, unit_dim: DataFrame, plan: DataFrame, origins: DataFrame,
    model: DataFrame | None = None, calibration: DataFrame | None = None, calibration_keys=("site",), model_keys=("site",),
) -> DataFrame:
    """One row per (cascade, origin) with the array of its sites.

    Models and calibrations are found by site, or by cascade and site where a cascade is a candidate.
    """
    days = -(-S.HISTORY_HOURS // 24)
    daily = with_origin_days(daily_arrays(series, ["site"], "total", name="hours"), ["site"], origins)
    w = Window.partitionBy("site").orderBy("d").rowsBetween(-days, -1)
    hist = (
        daily.select("site", F.col("d").cast("timestamp_ntz").alias("origin"), F.flatten(F.collect_list("hours").over(w)).alias("history"))
        .where(F.size("history") > 0)
        .join(origins.select("origin").distinct(), "origin", "left_semi")
    )
    rows = members.join(hist, "site").join(unit_states(units, unit_dim, plan, origins), ["site", "origin"])
    rows = _with(_with(rows, model, NO_MODEL, list(model_keys)), calibration, NO_CALIBRATION, list(calibration_keys))
    packed = F.struct("site", "upstream_site", "live", "capacity", "history", "units", *NO_MODEL, *NO_CALIBRATION)
    return rows.groupBy("cascade", "origin").agg(F.collect_list(packed).alias("sites"))


ORIGINS_TOGETHER = 32


def rollout_24h(state: DataFrame, feed_back: str = "backtest", partitions: int | None = None, trees: DataFrame | None = None) -> DataFrame:
    """(cascade, origin, site, h) with the predicted total and unit values.

    The stage is bound by arithmetic, not bytes, so states are spread over all
    cores instead of being merged into few partitions by size.

    ``trees`` are ensembles per site (or per cascade and site, for candidates). They
    are large beside a state, so they do not travel with each: up to
    ``ORIGINS_TOGETHER`` days of a cascade meet its sites' ensembles once.
    """
    if trees is None:
        n = partitions or 2 * state.sparkSession.sparkContext.defaultParallelism
        out = state.repartition(n, "cascade", "origin").mapInPandas(batches(feed_back), RESULT)
        return out.withColumn("ts", add_hours("origin", F.col("h") - 1))
    chunk = F.floor(F.datediff(F.col("origin"), F.lit("1970-01-01").cast("date")) / ORIGINS_TOGETHER)
    state = cut_lineage(state.withColumn("chunk", chunk))
    places = state.select(F.col("cascade").alias("cascade"), F.col("chunk").alias("chunk"), F.explode("sites.site").alias("site")).distinct()
    keys = ["cascade", "site"] if "cascade" in trees.columns else ["site"]
    own = places.join(trees.select(*keys, "base", *ARRAYS), keys)
    pairs = state.groupBy("cascade", "chunk").cogroup(own.groupBy("cascade", "chunk"))
    return pairs.applyInPandas(tree_group(feed_back), RESULT).withColumn("ts", add_hours("origin", F.col("h") - 1))


def unit_rows(forecast: DataFrame) -> DataFrame:
    pairs = F.explode(F.arrays_zip("units", "unit_mw")).alias("u")
    return forecast.select("cascade", "origin", "site", "h", "ts", pairs).select(
        "cascade", "origin", "site", "h", "ts", F.col("u.units").alias("unit"), F.col("u.unit_mw").alias("mw")
    )


def attach_actuals(forecast: DataFrame, series: DataFrame) -> DataFrame:
    """Predictions joined to the recorded values of the same site and hour."""
    actual = series.select("site", "ts", F.col("total").alias("actual"))
    return forecast.join(actual, ["site", "ts"])


def pack_bins(fit: DataFrame, basis: str = "current") -> DataFrame:
    """A fit of value bins as calibration columns; ``basis`` is what its edges are on, "current" or "pred"."""
    own = F.col("basis") if "basis" in fit.columns else F.lit(basis)
    return fit.select("site", F.col("scale").alias("bin_scale"), F.col("edges").alias("bin_edges"), F.col("corrections").alias("bin_shifts"), own.alias("bin_basis"))


def pack_calibration(shrink: DataFrame, bins=None, hourly=None, profile=None, ramps=None, level=None) -> DataFrame:
    """Fitted steps -> one calibration row per site; absent steps stay NULL."""
    out = shrink.select("site", "shrinkage", "bias")
    if bins is not None:
        out = out.join(pack_bins(bins), "site", "left")
    if hourly is not None:
        by_hour = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda h: F.coalesce(F.try_element_at("corrections", h), F.lit(0.0)))
        out = out.join(hourly.select("site", F.col("scale").alias("hour_scale"), by_hour.alias("hour_shift")), "site", "left")
    if profile is not None:
        out = out.join(profile.select("site", "blend_weight"), "site", "left")
    if level is not None:
        out = out.join(level.select("site", "anchor_weight", F.col("current_weight").alias("anchor_current")), "site", "left")
    return out if ramps is None else out.join(ramps.select("site", "ramp"), "site", "left")
