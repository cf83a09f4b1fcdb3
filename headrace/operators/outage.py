"""Outage plans and the allocation of site forecasts to units.

A site has a handful of units, so windows over (site, ts) are tiny groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import add_hours
from .slices import daily_arrays, last_known

TOL = 1e-6


def horizon(origins: DataFrame) -> DataFrame:
    """One row per origin-relative hour: h = 1..24 and its timestamp."""
    return origins.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(S.HORIZON)))).withColumn(
        "ts", add_hours("origin", F.col("h") - 1)
    )


def outage_plan_last_known(status: DataFrame, origins: DataFrame) -> DataFrame:
    """Last status before each origin, held for 24 hours; unknown counts as available."""
    known = last_known(status, ["site", "unit"], "available", origins)
    plan = horizon(known.withColumn("available", F.coalesce("available", F.lit(1))))
    return plan.select("site", "unit", "origin", "ts", "available")


def outage_plan_informed(units: DataFrame, recorded: DataFrame, origins: DataFrame) -> DataFrame:
    """Recorded same-day status (a sensitivity scenario); missing hours count as available.

    ``units`` holds (site, unit); the days are few, so they ride along as one
    array that is exploded per unit instead of a cross join.
    """
    days = origins.agg(F.sort_array(F.collect_set("origin")).alias("o")).select("o").scalar()
    grid = horizon(units.select("site", "unit", F.explode(days).alias("origin")))
    return grid.join(recorded.select("site", "unit", "ts", "available"), ["site", "unit", "ts"], "left").select(
        "site", "unit", "origin", "ts", F.coalesce("available", F.lit(1)).alias("available")
    )


def available_capacity(status: DataFrame, unit_dim: DataFrame, name: str = "available_capacity") -> DataFrame:
    """Capacity of the available units per site and hour."""
    on = F.when(F.coalesce("available", F.lit(1)) > 0, F.col("capacity")).otherwise(0.0)
    return status.join(unit_dim, ["site", "unit"]).groupBy("site", "ts").agg(
        F.sum(on.cast("decimal(18,6)")).cast("double").alias(name)
    )


def availability_ratio(baseline: DataFrame, planned: DataFrame, unit_dim: DataFrame, site_dim: DataFrame) -> DataFrame:
    """Planned over baseline available capacity, with its two fallbacks."""
    both = available_capacity(baseline, unit_dim, "base").join(available_capacity(planned, unit_dim, "plan"), ["site", "ts"])
    ratio = (
        F.when(F.col("plan") <= 0, F.lit(0.0))
        .when(F.col("base") <= 0, F.try_divide("plan", "capacity"))
        .otherwise(F.try_divide("plan", "base"))
    )
    return both.join(site_dim.select("site", "capacity"), "site").select("site", "ts", ratio.alias("ratio"))


def unit_shares(units: DataFrame, value: str = "mw") -> DataFrame:
    """max(unit, 0) / site total; no share while the total is zero."""
    total = F.sum(F.coalesce(F.col(value), F.lit(0.0)).cast("decimal(18,6)")).over(Window.partitionBy("site", "ts")).cast("double")
    return units.select("site", "unit", "ts", F.try_divide(F.greatest(F.col(value), F.lit(0.0)), F.nullif(total, F.lit(0.0))).alias("share"))


def array_median(values: Column) -> Column:
    v = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2.0)


def learned_weights(units: DataFrame, unit_dim: DataFrame) -> DataFrame:
    """Allocation weights per (site, unit, origin day, hour).

    0.50 current share + 0.35 median of the last 168 + 0.15 median of the last
    56 same-hour shares; each part is normalised over the site's units, absent
    parts are skipped, and capacity decides when none is left. The history is
    kept as one array of shares per unit and day.
    """
    daily = daily_arrays(unit_shares(units), ["site", "unit"], "share", name="hours", by_hour="_by_hour")
    w = Window.partitionBy("site", "unit").orderBy("d")
    back = lambda n: F.collect_list("hours").over(w.rowsBetween(-n, -1))
    recent_days = S.RECENT_SHARE_HOURS // 24
    states = daily.select(
        "site", "unit", F.col("d").cast("timestamp_ntz").alias("origin"),
        F.element_at(F.lag("hours").over(w), -1).alias("p_now"),
        array_median(F.flatten(back(recent_days))).alias("p_recent"),
        F.collect_list("_by_hour").over(w.rowsBetween(-S.SAME_HOUR_SHARES, -1)).alias("_days"),
    ).where(F.size("_days") > 0)
    hourly = horizon(states).withColumn(
        "p_hour", array_median(F.transform("_days", lambda day: F.get(day, F.col("h") - 1)))
    ).drop("_days")
    peers = Window.partitionBy("site", "ts")
    out = hourly.join(unit_dim, ["site", "unit"])
    total = F.lit(0.0)
    for part, weight in zip(("p_now", "p_recent", "p_hour"), S.SHARE_WEIGHTS):
        mass = F.sum(part).over(peers)
        total = total + F.when(mass > 0, F.coalesce(F.col(part) / mass, F.lit(0.0)) * weight).otherwise(0.0)
    out = out.withColumn("mix", total)
    all_mix, all_cap = F.sum("mix").over(peers), F.sum("capacity").over(peers)
    weight = F.when(all_mix > 0, F.col("mix") / all_mix).otherwise(F.col("capacity") / all_cap)
    return out.select("site", "unit", "origin", "ts", "capacity", weight.alias("weight"))


def allocate_with_caps(rows: DataFrame) -> DataFrame:
    """Share ``total`` over units in proportion to ``weight``, never above ``capacity``.

    Repeated proportional rounds under caps end at min(capacity, level * weight)
    for one common level. Sorted by capacity/weight, a unit is at its cap exactly
    when filling everybody up to its own ratio needs no more than the total, so
    running sums give the level without iterating. Whatever the weighted units
    cannot take goes to units of weight zero in proportion to capacity.
    """
    peers = Window.partitionBy("site", "ts")
    on = F.coalesce(F.col("available"), F.lit(1)) > 0 if "available" in rows.columns else F.lit(True)
    base = rows.withColumn("_cap", F.when(on, F.col("capacity")).otherwise(0.0)).withColumn(
        "_w", F.when(on, F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    )
    base = base.withColumn("_t", F.least(F.greatest(F.col("total"), F.lit(0.0)), F.sum("_cap").over(peers)))
    base = base.withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")))
    order = peers.orderBy(F.col("_ratio").asc_nulls_last(), "unit")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    heavy = F.when(F.col("_w") > 0, F.col("_cap")).otherwise(0.0)
    cap_before = F.coalesce(F.sum(heavy).over(before), F.lit(0.0))
    w_from = F.sum("_w").over(peers) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    ranked = base.withColumn("_full", (F.col("_w") > 0) & (cap_before + F.col("_ratio") * w_from <= F.col("_t")))
    full_cap = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(peers)
    free_w = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(peers)
    idle_cap = F.sum(F.when(F.col("_w") > 0, 0.0).otherwise(F.col("_cap"))).over(peers)
    rest = F.col("_t") - full_cap
    mw = (
        F.when(F.col("_full"), F.col("_cap"))
        .when(F.col("_w") > 0, F.try_divide(rest * F.col("_w"), free_w))
        .when(free_w > 0, F.lit(0.0))
        .otherwise(F.coalesce(F.try_divide(rest * F.col("_cap"), idle_cap), F.lit(0.0)))
    )
    out = F.least(F.greatest(mw, F.lit(0.0)), F.col("_cap"))
    return ranked.select(*rows.columns, out.alias("mw"))


def apply_outage(rows: DataFrame, reallocate: bool = False) -> DataFrame:
    """Allocate as if every unit ran, then drop the unavailable ones.

    The lost output is not moved to other units unless ``reallocate`` is set.
    ``base_mw`` keeps the value before the outage.
    """
    if reallocate:
        return allocate_with_caps(rows).withColumn("base_mw", F.col("mw"))
    alloc = allocate_with_caps(rows.withColumnRenamed("available", "_a")).withColumnRenamed("_a", "available")
    return alloc.withColumn("base_mw", F.col("mw")).withColumn(
        "mw", F.when(F.coalesce("available", F.lit(1)) <= 0, 0.0).otherwise(F.col("mw"))
    )


def reconcile_totals(units: DataFrame) -> DataFrame:
    """Outages zeroed, caps enforced; unit, site and cascade rows from one rollup."""
    capped = F.least(F.greatest(F.col("mw"), F.lit(0.0)), F.col("capacity"))
    fixed = units.withColumn("mw", F.when(F.coalesce("available", F.lit(1)) <= 0, 0.0).otherwise(capped))
    sets = [[F.col("ts"), F.col("site"), F.col("unit")], [F.col("ts"), F.col("site")], [F.col("ts")]]
    level = F.when(F.grouping("site") == 1, "cascade").when(F.grouping("unit") == 1, "site").otherwise("unit")
    return fixed.groupingSets(sets, "ts", "site", "unit").agg(level.alias("level"), F.sum("mw").alias("mw"))


def validate_outage_effect(units: DataFrame, totals: DataFrame, cascade: DataFrame) -> DataFrame:
    """Violations as rows (kind, site, unit, ts, amount); empty when all is well.

    units: site, unit, ts, mw, available; totals: site, ts, total; cascade: ts, total.
    """
    on = F.coalesce("available", F.lit(1))
    before = F.lag(on).over(Window.partitionBy("site", "unit").orderBy("ts"))
    u = units.select("site", "unit", "ts", "mw", on.alias("on"), before.alias("was"))
    out = u.where((F.col("on") <= 0) & (F.abs("mw") > TOL)).select(F.lit("generation_while_out").alias("kind"), "site", "unit", "ts", F.col("mw").alias("amount"))
    back = (
        u.where((F.col("was") <= 0) & (F.col("on") > 0) & (F.col("mw") <= TOL))
        .join(totals, ["site", "ts"]).where(F.col("total") > TOL)
        .select(F.lit("zero_after_return").alias("kind"), "site", "unit", "ts", F.col("mw").alias("amount"))
    )
    active = F.when(F.col("mw") > TOL, F.col("mw"))
    sums = u.groupBy("site", "ts").agg(
        F.sum("mw").alias("s"), F.count(active).alias("n"), F.min(active).alias("low"), F.max(active).alias("high")
    )
    none = F.lit(None).cast("string")
    gap = (F.col("total") - F.col("s")).alias("amount")
    site = sums.join(totals, ["site", "ts"]).where(F.abs(F.col("total") - F.col("s")) > TOL).select(
        F.lit("site_total_mismatch").alias("kind"), "site", none.alias("unit"), "ts", gap
    )
    same = sums.where((F.col("n") > 1) & (F.col("high") - F.col("low") <= TOL)).select(
        F.lit("identical_active_units").alias("kind"), "site", none.alias("unit"), "ts", F.col("high").alias("amount")
    )
    sites = totals.groupBy("ts").agg(F.sum("total").alias("s"))
    top = sites.join(cascade, "ts").where(F.abs(F.col("total") - F.col("s")) > TOL).select(
        F.lit("cascade_total_mismatch").alias("kind"), none.alias("site"), none.alias("unit"), "ts", gap
    )
    return out.unionByName(back).unionByName(site).unionByName(same).unionByName(top)


def outage_summary(plan: DataFrame, keys=()) -> DataFrame:
    """Unit-hours out and available, units and sites touched by an outage, for each of ``keys``.

    Hours are merged per unit first, so the final single row sees units only.
    ``sites`` is NULL where no outage touches a site.
    """
    off = F.coalesce("available", F.lit(1)) <= 0
    per_unit = plan.groupBy(*keys, "site", "unit").agg(F.count_if(off).alias("out"), F.count_if(~off).alias("on"))
    hit = F.when(F.col("out") > 0, F.concat_ws("_", "site", "unit"))
    sites = F.collect_set(F.when(F.col("out") > 0, F.col("site")))
    return per_unit.groupBy(*keys).agg(
        F.sum("out").alias("unavailable_hours"), F.sum("on").alias("available_hours"),
        F.count(hit).alias("affected_units"), F.count_distinct(F.when(F.col("out") > 0, F.col("site"))).alias("affected_sites"),
        F.when(F.size(sites) > 0, F.array_join(F.sort_array(sites), ",")).alias("sites"),
    )
