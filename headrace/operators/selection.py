"""Choosing configurations and calibration steps by rolling validation scores.

Every candidate is a cascade of its own in one rollout job, so nothing loops
over sites, days or candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import metric_columns, score_struct
from ..session import cut_lineage
from . import calibration as H
from . import rollout as J


def screen(rows: DataFrame, finalists: int = S.FINALISTS_PRIMARY, weight: float = S.R2_WEIGHT_PRIMARY) -> DataFrame:
    """Best ``finalists`` of the shrinkage grid per site by one-step score."""
    grid = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(s).alias("shrinkage")) for i, s in enumerate(S.SHRINKAGE_GRID)])
    spread = rows.withColumn("g", F.explode(grid)).select("*", "g.*")
    scored = (
        spread.withColumn("cand", H.level_from_delta(shrinkage=F.col("shrinkage")))
        .groupBy("site", "k", "shrinkage").agg(*metric_columns("actual", "cand")).withColumn("score", score_struct(weight))
    )
    # Bounded: one row per grid point and site.
    rank = F.row_number().over(Window.partitionBy("site").orderBy("score", "k"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= finalists).select("site", "k", "shrinkage", "rank")


def rolling_scores(
    make_states: Callable[[DataFrame, DataFrame], DataFrame], members: DataFrame, calibration: DataFrame,
    series: DataFrame, capacity: DataFrame, weight: float = S.R2_WEIGHT_PRIMARY, trees: DataFrame | None = None,
) -> DataFrame:
    """Rolling 24-hour metrics and score per (cascade, site); cascade = candidate.

    ``make_states(members, calibration)`` builds the rollout states; ``trees`` are
    the candidates' ensembles by (cascade, site).
    """
    forecast = J.rollout_24h(make_states(members, calibration), trees=trees)
    joined = J.attach_actuals(forecast, series).join(capacity.select("site", "capacity"), "site")
    scored = joined.groupBy("cascade", "site").agg(
        F.count_distinct("origin").alias("forecast_days"), F.count(F.lit(1)).alias("forecast_hours"), *metric_columns()
    )
    return scored.withColumn("score", score_struct(weight))


def candidate_members(singles: DataFrame, candidates: DataFrame, tag) -> DataFrame:
    """Copy each single-site cascade once per candidate of that site."""
    tags = candidates.select(F.col("site").alias("cascade"), tag.alias("_tag")).distinct()
    return singles.join(tags, "cascade").withColumn("cascade", F.concat_ws("|", "cascade", "_tag")).drop("_tag")


def two_stage_select(
    rows: DataFrame, make_states, singles: DataFrame, series: DataFrame, capacity: DataFrame,
    finalists: int = S.FINALISTS_RIVAL, weight: float = S.R2_WEIGHT_PRIMARY,
) -> DataFrame:
    """Screen by one-step score, then pick by the rolling 24-hour score."""
    top = cut_lineage(screen(rows, finalists, weight))
    tag = F.col("k").cast("string")
    members = candidate_members(singles, top, tag)
    calibration = top.select(F.concat_ws("|", "site", tag).alias("cascade"), "site", "shrinkage", F.lit(0.0).alias("bias"))
    scores = rolling_scores(make_states, members, calibration, series, capacity, weight)
    ranked = scores.join(calibration, ["cascade", "site"])
    best = F.min(F.struct("score", F.split("cascade", r"\|")[1].cast("int").alias("k"), "shrinkage", "forecast_days", "operational_mape", "mae", "rmse", "r2"))
    return ranked.groupBy("site").agg(F.count(F.lit(1)).alias("finalists"), best.alias("b")).select("site", "finalists", "b.*").drop("score")


def screen_points(rows: DataFrame, finalists: int, weight: float) -> DataFrame:
    """Best ``finalists`` per site of all (search point, shrinkage) pairs by one-step score; ``rows`` have ``point`` and ``delta``."""
    grid = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(s).alias("shrinkage")) for i, s in enumerate(S.SHRINKAGE_GRID)])
    scored = (
        rows.withColumn("g", F.explode(grid)).select("*", "g.*").withColumn("cand", H.level_from_delta(shrinkage=F.col("shrinkage")))
        .groupBy("site", "point", "k", "shrinkage").agg(*metric_columns("actual", "cand")).withColumn("score", score_struct(weight))
    )
    # Bounded: one row per search point, grid point and site.
    rank = F.row_number().over(Window.partitionBy("site").orderBy("score", "point", "k"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= finalists).select("site", "point", "k", "shrinkage", "rank")


def select_models(
    rows: DataFrame, models: DataFrame, make_states, singles: DataFrame, series: DataFrame, capacity: DataFrame,
    finalists: int = S.FINALISTS_RIVAL, weight: float = S.R2_WEIGHT_RIVAL,
) -> DataFrame:
    """Every search point and shrinkage screened by one-step score, finalists by the rolling 24-hour score.

    ``models`` are by (site, point): tree ensembles, or radial models (with ``coef``),
    which ``make_states`` then gets by (cascade, site) as its third argument. All
    finalists of all sites are cascades of one rollout; each takes its own model along.
    """
    top = cut_lineage(screen_points(rows, finalists, weight))
    tag = F.concat_ws("|", F.col("point"), F.col("k"))
    named = top.withColumn("cascade", F.concat_ws("|", "site", tag))
    members = candidate_members(singles, top, tag)
    calibration = named.select("cascade", "site", "shrinkage", F.lit(0.0).alias("bias"))
    own = named.select("cascade", "site", "point").join(models.drop("family", "rows"), ["site", "point"])
    radial = "coef" in models.columns
    make = (lambda m, c: make_states(m, c, own)) if radial else make_states
    scores = rolling_scores(make, members, calibration, series, capacity, weight, None if radial else own)
    ranked = scores.join(named.select("cascade", "site", "point", "k", "shrinkage"), ["cascade", "site"])
    best = F.min(F.struct("score", "point", "k", "shrinkage", "forecast_days", "operational_mape", "mae", "rmse", "r2"))
    return ranked.groupBy("site").agg(F.count(F.lit(1)).alias("finalists"), best.alias("b")).select("site", "finalists", "b.*").drop("score")


STEPS = ("bin", "hour", "blend", "anchor")
FIELDS = {
    "bin": ["bin_scale", "bin_edges", "bin_shifts", "bin_basis"], "hour": ["hour_scale", "hour_shift"], "blend": ["blend_weight"],
    "anchor": ["anchor_weight", "anchor_current"],
}


def staged_accept(
    rows: DataFrame, make_states, singles: DataFrame, series: DataFrame, capacity: DataFrame,
    ramps: DataFrame | None = None, strict: bool = True, weight: float = S.R2_WEIGHT_PRIMARY, steps=STEPS, bin_rules: DataFrame | None = None,
) -> DataFrame:
    """Add bins, hourly correction, blend and level anchor in turn; keep what helps each site.

    Each stage fits on the one-step predictions accepted so far and is judged
    by the rolling score (``<``, or ``<=`` with ``strict=False``). At most four
    stages, one rollout job each, in which both variants of every site run together.
    ``bin_rules`` are those of :func:`calibration.fit_bin_calibration_by_site`.
    """
    shrink = cut_lineage(H.fit_shrinkage_bias(rows, weight))
    accepted = J.pack_calibration(shrink, ramps=ramps)
    current = cut_lineage(H.apply_shrinkage_bias(rows, shrink))
    log = shrink.select("site", "shrinkage", "bias")
    for step in steps:
        if step == "bin":
            fit = H.fit_bin_calibration(current, weight=weight) if bin_rules is None else H.fit_bin_calibration_by_site(current, bin_rules, weight)
            packed, apply = J.pack_bins(fit), H.apply_bin_calibration
        elif step == "hour":
            fit, apply = H.fit_hourly_correction(current, weight=weight), H.apply_hourly_correction
            packed = J.pack_calibration(shrink, hourly=fit).select("site", "hour_scale", "hour_shift")
        elif step == "blend":
            fit, apply = H.fit_profile_blend(current, weight), H.apply_profile_blend
            packed = fit.select("site", "blend_weight")
        else:
            fit, apply = H.fit_level_anchor_blend(current, weight), H.apply_level_anchor_blend
            packed = J.pack_calibration(shrink, level=fit).select("site", *FIELDS["anchor"])
        packed = cut_lineage(packed)
        both = accepted.withColumn("_v", F.lit("without")).unionByName(
            accepted.drop(*FIELDS[step]).join(packed, "site").withColumn("_v", F.lit("with")), allowMissingColumns=True
        )
        calibration = both.withColumn("cascade", F.concat_ws("|", "site", "_v")).drop("_v")
        tags = F.explode(F.array(F.lit("without"), F.lit("with")))
        members = singles.withColumn("_v", tags).withColumn("cascade", F.concat_ws("|", "cascade", "_v")).drop("_v")
        scores = rolling_scores(make_states, members, calibration, series, capacity, weight)
        side = lambda v: F.max(F.when(F.col("cascade").endswith(f"|{v}"), F.col("score")))
        better = (side("with") < side("without")) if strict else (side("with") <= side("without"))
        verdict = cut_lineage(scores.groupBy("site").agg(F.coalesce(better, F.lit(False)).alias(f"{step}_accepted")))
        keep = packed.join(verdict.where(F.col(f"{step}_accepted")), "site", "left_semi")
        accepted = cut_lineage(accepted.drop(*FIELDS[step]).join(keep, "site", "left"))
        ok = verdict.where(F.col(f"{step}_accepted")).select("site")
        moved = apply(current.join(ok, "site", "left_semi"), fit)
        current = cut_lineage(moved.select(*current.columns).unionByName(current.join(ok, "site", "left_anti")))
        log = log.join(verdict, "site")
    return log.join(accepted.drop("shrinkage", "bias"), "site")
