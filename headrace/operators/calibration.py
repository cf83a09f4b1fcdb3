"""Calibration fitted on validation rows only.

Input rows have ``site, ts, target_hour, current, delta, actual, anchor,
capacity`` and, after the first step, ``pred``. A fit is a small table with one
row per site. Grids are exploded as literals; the exploded rows are consumed by
the map-side half of the aggregation and never reach a shuffle. Value bins are
scored from one sort of a site's rows instead.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.bin_kernel import fit_site
from ..functions.expr import cap_clip, clip, metric_columns, operational_threshold, score_struct
from ..session import cut_lineage


def level_from_delta(current="current", delta="delta", capacity="capacity", shrinkage=1.0, bias=0.0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return cap_clip(F.col(current) + lit(shrinkage) * F.col(delta) + lit(bias), capacity)


def candidate_score(metrics: DataFrame, weight: float = S.R2_WEIGHT_PRIMARY) -> DataFrame:
    """Attach the lexicographic score (s1..s4) to a metrics table."""
    return metrics.withColumn("score", score_struct(weight)).select("*", "score.*").drop("score")


def _best(scored: DataFrame, keys: list[str], params: list[str], weight: float) -> DataFrame:
    """First candidate with the lowest score; ``k`` is its place in the grid."""
    pick = F.min(F.struct(score_struct(weight).alias("score"), "k", *params)).alias("best")
    return scored.groupBy(*keys).agg(pick).select(*keys, "best.k", *[f"best.{p}" for p in params], "best.score.*")


def fit_grid(
    rows: DataFrame, params: dict[str, list[float]], candidate: Column, weight: float = S.R2_WEIGHT_PRIMARY,
    keys=("site",), base: str | None = "pred",
) -> DataFrame:
    """Score ``candidate`` for every literal grid point; keep the best per key.

    ``params`` lists one value per grid point. With ``base``, leaving that
    column unchanged is candidate 0, wins ties, and has NULL parameters.
    """
    names = list(params)
    points = [
        F.struct(F.lit(i + 1).alias("k"), *[F.lit(float(params[n][i])).alias(n) for n in names])
        for i in range(len(params[names[0]]))
    ]
    if base:
        nothing = F.struct(F.lit(0).alias("k"), *[F.lit(None).cast("double").alias(n) for n in names])
        points.insert(0, nothing)
        tried = lambda df: df.withColumn("cand", F.when(F.col("k") == 0, F.col(base)).otherwise(candidate))
    else:
        tried = lambda df: df.withColumn("cand", candidate)
    spread = rows.withColumn("g", F.explode(F.array(*points))).select("*", "g.*").drop("g")
    scored = tried(spread).groupBy(*keys, "k", *names).agg(*metric_columns("actual", "cand"))
    return _best(scored, list(keys), names, weight)


def fit_shrinkage_bias(rows: DataFrame, weight: float = S.R2_WEIGHT_PRIMARY) -> DataFrame:
    """(site, shrinkage, bias): bias is the clipped median residual per shrinkage."""
    grid = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(s).alias("shrinkage")) for i, s in enumerate(S.SHRINKAGE_GRID)])
    spread = rows.withColumn("g", F.explode(grid)).select("*", "g.*").drop("g")
    spread = spread.withColumn("raw", level_from_delta(shrinkage=F.col("shrinkage")))
    limit = operational_threshold(F.first("capacity"))
    biases = spread.groupBy("site", "k").agg(clip(F.median(F.col("actual") - F.col("raw")), -limit, limit).alias("bias"))
    scored = (
        spread.join(biases, ["site", "k"])
        .withColumn("cand", cap_clip(F.col("raw") + F.col("bias"), "capacity"))
        .groupBy("site", "k", "shrinkage", "bias")
        .agg(*metric_columns("actual", "cand"))
    )
    return _best(scored, ["site"], ["shrinkage", "bias"], weight)


def apply_shrinkage_bias(rows: DataFrame, fit: DataFrame) -> DataFrame:
    out = rows.join(fit.select("site", "shrinkage", "bias"), "site")
    return out.withColumn("pred", level_from_delta(shrinkage=F.col("shrinkage"), bias=F.col("bias"))).drop("shrinkage", "bias")


# --- value bins ------------------------------------------------------------

def bin_id(value, edges="edges") -> Column:
    """Number of inner edges at or below the value."""
    v = F.round(F.col(value), 9)
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e <= v))


def fit_bin_calibration(
    rows: DataFrame, basis: str = "current", quantiles=S.BIN_QUANTILES, scales=S.BIN_SCALES, weight: float = S.R2_WEIGHT_PRIMARY
) -> DataFrame:
    """(site, q, scale, edges, corrections); NULLs where no bins help."""
    return _fit_bins(rows.withColumns({"_value": F.col(basis), "_wide": F.lit(False)}), {False: quantiles}, scales, weight)


def _fit_bins(rows: DataFrame, counts: dict, scales, weight: float) -> DataFrame:
    """Bins of ``_value`` per site, with the numbers of bins that ``_wide`` stands for.

    A site's rows are shuffled once and sorted once (they are bounded, one a
    validation hour); every number of bins and every scale is scored from that
    order, and one row per site and number comes back. Rows without an actual or a
    prediction have no part; rows without a value are in the lowest bin.
    """
    choices = {k: [int(q) for q in v] for k, v in counts.items()}
    steps, headroom = [float(s) for s in scales], S.CAPACITY_HEADROOM
    kind = rows.schema["site"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = fit_site(pdf, choices[bool(pdf["wide"].iloc[0])], steps, headroom)
        out = pd.DataFrame(found, columns=["q", "edges", "corrections", "operational_mape", "rmse", "r2"])
        out.insert(0, "site", pdf["site"].iloc[0])
        return out

    scored = rows.where("actual is not null and pred is not null")
    need = scored.select(
        "site", F.round(F.col("_value").cast("double"), 9).alias("value"), F.col("actual").cast("double").alias("actual"),
        F.col("pred").cast("double").alias("pred"), F.col("capacity").cast("double").alias("capacity"), F.col("_wide").alias("wide"),
    )
    # One row per site and number of bins, read by the choice and by the join that follows it.
    tables = cut_lineage(need.groupBy("site").applyInPandas(
        run, f"site {kind}, q int, edges array<double>, corrections map<int,double>, operational_mape array<double>, rmse array<double>, r2 array<double>",
    ))
    each = F.arrays_zip(F.sequence(F.lit(1), F.lit(len(steps))).alias("j"), F.array(*[F.lit(s) for s in steps]).alias("scale"), "operational_mape", "rmse", "r2")
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    metrics = ["operational_mape", "rmse", "r2"]
    tried = (
        tables.select("site", "q", F.explode(each).alias("g")).select("site", "q", "g.*")
        .select("site", (F.col("q") * 1000 + F.col("j")).alias("k"), "q", "scale", *[number(c) for c in metrics])
    )
    base = scored.groupBy("site").agg(*metric_columns("actual", "pred")).select(
        "site", F.lit(0).alias("k"), F.lit(None).cast("int").alias("q"), F.lit(None).cast("double").alias("scale"), *metrics
    )
    best = _best(tried.unionByName(base), ["site"], ["q", "scale"], weight)
    return best.join(tables.select("site", "q", "edges", "corrections"), ["site", "q"], "left").select(*best.columns, "edges", "corrections")


def fit_bin_calibration_by_site(rows: DataFrame, rules: DataFrame, weight: float = S.R2_WEIGHT_PRIMARY) -> DataFrame:
    """Bins whose basis and largest count are each site's own: (site, basis, q, scale, edges, corrections).

    ``rules`` has ``site, basis, wide``: the basis is "current" or "pred" (the base
    prediction), and ``wide`` sites try up to 40 bins instead of 20. Sites without a
    rule have neither.
    """
    own = rows.join(rules.select("site", "basis", F.col("wide").alias("_wide")), "site", "left").withColumns({
        "basis": F.coalesce("basis", F.lit("current")), "_wide": F.coalesce("_wide", F.lit(False)),
    })
    value = F.when(F.col("basis") == "pred", F.col("pred")).otherwise(F.col("current"))
    own = own.withColumn("_value", value)
    fits = _fit_bins(own, {False: S.BIN_QUANTILES, True: S.BIN_QUANTILES_WIDE}, S.BIN_SCALES, weight)
    return fits.join(own.groupBy("site").agg(F.first("basis").alias("basis"), F.first("_wide").alias("wide")), "site")


def apply_bin_calibration(rows: DataFrame, fit: DataFrame, basis: str = "current") -> DataFrame:
    """Add scale * correction of the value's bin; unknown bins add nothing.

    A fit with a column ``basis`` names it for each site.
    """
    named = "basis" in fit.columns
    own = fit.select("site", "scale", "edges", "corrections", *([F.col("basis").alias("_basis")] if named else []))
    out = rows.join(own, "site", "left")
    if named:
        out = out.withColumn("_value", F.when(F.col("_basis") == "pred", F.col("pred")).otherwise(F.col("current")))
    shift = F.coalesce(F.try_element_at("corrections", bin_id("_value" if named else basis)), F.lit(0.0))
    done = cap_clip(F.col("pred") + F.col("scale") * shift, "capacity")
    return out.withColumn("pred", F.when(F.col("scale").isNotNull(), done).otherwise(F.col("pred"))).drop("scale", "edges", "corrections", "_basis", "_value")


# --- hour of day -----------------------------------------------------------

def hourly_medians(rows: DataFrame, clip_share: float | None = S.HOURLY_CLIP_SHARE) -> DataFrame:
    shift = F.median(F.col("actual") - F.col("pred"))
    if clip_share is not None:
        limit = F.greatest(F.lit(1.0), F.first("capacity") * clip_share)
        shift = clip(shift, -limit, limit)
    return rows.groupBy("site", "target_hour").agg(shift.alias("shift"))


def fit_hourly_correction(rows: DataFrame, clip_share: float | None = S.HOURLY_CLIP_SHARE, weight: float = S.R2_WEIGHT_PRIMARY) -> DataFrame:
    """(site, scale, corrections by target hour)."""
    med = hourly_medians(rows, clip_share)
    cand = cap_clip(F.col("pred") + F.col("scale") * F.coalesce("shift", F.lit(0.0)), "capacity")
    best = fit_grid(rows.join(med, ["site", "target_hour"], "left"), {"scale": S.HOURLY_SCALES}, cand, weight)
    corr = med.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("target_hour", "shift"))).alias("corrections"))
    return best.join(corr, "site")


def apply_hourly_correction(rows: DataFrame, fit: DataFrame) -> DataFrame:
    shift = F.coalesce(F.try_element_at("corrections", F.col("target_hour")), F.lit(0.0))
    done = cap_clip(F.col("pred") + F.col("scale") * shift, "capacity")
    out = rows.join(fit.select("site", "scale", "corrections"), "site", "left")
    return out.withColumn("pred", F.when(F.col("scale").isNotNull(), done).otherwise(F.col("pred"))).drop("scale", "corrections")


# --- blends ----------------------------------------------------------------

def blend(weight, anchor="anchor", pred="pred") -> Column:
    """Blend towards the anchor; rows without one stay unblended."""
    mixed = (1.0 - weight) * F.col(pred) + weight * F.col(anchor)
    return cap_clip(F.coalesce(mixed, F.col(pred)), "capacity")


def fit_profile_blend(rows: DataFrame, weight: float = S.R2_WEIGHT_PRIMARY, weights=S.PROFILE_WEIGHTS) -> DataFrame:
    return fit_grid(rows, {"blend_weight": weights}, blend(F.col("blend_weight")), weight)


def apply_profile_blend(rows: DataFrame, fit: DataFrame) -> DataFrame:
    out = rows.join(fit.select("site", "blend_weight"), "site", "left")
    mixed = F.when(F.col("blend_weight").isNotNull(), blend(F.col("blend_weight"))).otherwise(F.col("pred"))
    return out.withColumn("pred", mixed).drop("blend_weight")


def anchor_blend(weight, current_weight) -> Column:
    w = F.least(weight, F.lit(S.ANCHOR_WEIGHT_CAP))
    anchor = current_weight * F.coalesce("current", F.lit(0.0)) + (1.0 - current_weight) * F.coalesce("anchor", F.lit(0.0))
    return cap_clip((1.0 - w) * F.col("pred") + w * anchor, "capacity")


def fit_level_anchor_blend(rows: DataFrame, weight: float = S.R2_WEIGHT_RIVAL) -> DataFrame:
    pairs = [(c, w) for c in S.ANCHOR_WEIGHTS for w in S.ANCHOR_WEIGHTS]
    params = {"current_weight": [c for c, _ in pairs], "anchor_weight": [w for _, w in pairs]}
    return fit_grid(rows, params, anchor_blend(F.col("anchor_weight"), F.col("current_weight")), weight)


def apply_level_anchor_blend(rows: DataFrame, fit: DataFrame) -> DataFrame:
    out = rows.join(fit.select("site", "current_weight", "anchor_weight"), "site", "left")
    mixed = F.when(F.col("anchor_weight").isNotNull(), anchor_blend(F.col("anchor_weight"), F.col("current_weight"))).otherwise(F.col("pred"))
    return out.withColumn("pred", mixed).drop("current_weight", "anchor_weight")


def tune_saved_blend(stored: DataFrame, history: DataFrame, weights=S.SAVED_BLEND_WEIGHTS, weight: float = S.R2_WEIGHT_PRIMARY) -> DataFrame:
    """Blend weight for stored validation predictions, with its acceptance gate.

    ``stored``: model, site, ts, actual, predicted, capacity; the anchor is the
    recorded value one day earlier. A weight is adopted only if the score
    improves while RMSE and R2 do not get worse.
    """
    past = history.select("site", (F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.col("total").alias("anchor"))
    rows = stored.join(past, ["site", "ts"]).where("anchor is not null").withColumn("pred", F.col("predicted"))
    grid = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(w).alias("w")) for i, w in enumerate([0.0, *weights])])
    cand = F.when(F.col("k") == 0, F.col("pred")).otherwise(blend(F.col("w")))
    scored = (
        rows.withColumn("g", F.explode(grid)).select("*", "g.*").withColumn("cand", cand)
        .groupBy("model", "site", "k", "w").agg(*metric_columns("actual", "cand"))
        .withColumn("score", score_struct(weight))
    )
    # Bounded: one row per grid point and (model, site).
    w = Window.partitionBy("model", "site")
    base = lambda c: F.max(F.when(F.col("k") == 0, F.col(c))).over(w)
    best = (
        scored.select("*", base("rmse").alias("rmse_before"), base("r2").alias("r2_before"))
        .groupBy("model", "site")
        .agg(F.min(F.struct("score", "k", F.col("w").alias("weight"), "rmse", "r2", "rmse_before", "r2_before")).alias("b"))
        .select("model", "site", "b.*")
    )
    ok = (F.col("k") > 0) & (F.col("rmse") <= F.col("rmse_before")) & (F.col("r2") >= F.col("r2_before"))
    return best.select("model", "site", "weight", "rmse_before", F.col("rmse").alias("rmse_after"), F.coalesce(ok, F.lit(False)).alias("adopted"))


# --- ramps and the whole chain ---------------------------------------------

def ramp_limit(series: DataFrame, keys=("site",), value: str = "total", ts: str = "ts") -> DataFrame:
    """98th percentile of the absolute hourly change, at least 1; 2 without data."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(ts)))
    q = F.percentile("_d", F.lit(S.RAMP_QUANTILE))
    return series.withColumn("_d", step).groupBy(*keys).agg(
        F.when(q.isNull(), S.RAMP_DEFAULT).otherwise(F.greatest(F.lit(1.0), q)).alias("ramp")
    )


def pipeline_order(rows: DataFrame, shrink: DataFrame, bins: DataFrame, hourly: DataFrame, profile: DataFrame, ramps: DataFrame) -> DataFrame:
    """base + bias -> bins -> hour of day -> blend -> ramp clip -> capacity clip."""
    out = apply_shrinkage_bias(rows, shrink)
    out = apply_profile_blend(apply_hourly_correction(apply_bin_calibration(out, bins), hourly), profile)
    out = out.join(ramps, "site")
    limited = clip("pred", F.col("current") - F.col("ramp"), F.col("current") + F.col("ramp"))
    return out.withColumn("pred", cap_clip(limited, "capacity")).drop("ramp")
