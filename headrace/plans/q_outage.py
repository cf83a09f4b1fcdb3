"""Registered queries: outage plans and unit allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import baselines as G
from ..operators import outage as I
from ..session import cut_lineage
from . import fixtures as X
from .fixtures import r6s
from .q_features import filled_panel, rounded
from .registry import Registry

REG = Registry()

# The SQL side fills caps in explicit rounds; three units need at most four.
ROUNDS = 4


def _round(i: int) -> str:
    return f"""select *, least(greatest(alloc + add, 0), cap) as alloc2, active and not (add >= head) and cap - (alloc + add) > 1e-9 as active2 from (
        select *, case when active and rem > 1e-9 then least(share * rem, head) else 0 end as add from (
        select *, case when not active then 0 when wsum > 0 then weight / wsum else cap / nullif(csum, 0) end as share, cap - alloc as head from (
        select *, t - sum(alloc) over p as rem, sum(case when active then weight else 0 end) over p as wsum,
          sum(case when active then cap else 0 end) over p as csum from fill{i} window p as (partition by site, ts))))"""


OUT: dict[str, str] = {
    "plan_last": """select p.site, p.unit, o.origin, o.origin + h * interval 1 hour as ts, p.available
        from panel p join origins o on p.ts = o.origin - interval 1 hour cross join (select unnest(range(24)) as h)""",
    "recorded": "select site, unit, ts, case when mw > 0 then 1 else 0 end as available from u",
    "plan_same": """select p.site, p.unit, o.origin, p.ts, coalesce(r.available, 1) as available
        from panel p join origins o on cast(o.origin as date) = cast(p.ts as date)
        left join recorded r on r.site = p.site and r.unit = p.unit and r.ts = p.ts""",
    "filled": "select site, unit, ts, coalesce(mw, 0.0) as mw from panel",
    "shares": """select f.site, f.unit, f.ts, greatest(f.mw, 0) / nullif(s.total, 0) as share
        from filled f join site_series s on s.site = f.site and s.ts = f.ts""",
    "recent": """select s.site, s.unit, o.origin, median(share) as p_recent, arg_max_null(share, s.ts) as p_now
        from shares s join origins o on s.ts < o.origin and s.ts >= o.origin - interval 168 hour group by all""",
    "same_hour": """select s.site, s.unit, o.origin, hour(s.ts) as h, median(share) as p_hour
        from shares s join origins o on s.ts < o.origin and s.ts >= o.origin - interval 56 day group by all""",
    "parts": """select r.site, r.unit, r.origin, r.origin + h.h * interval 1 hour as ts, d.capacity, p_now, p_recent, p_hour,
        sum(p_now) over w as m1, sum(p_recent) over w as m2, sum(p_hour) over w as m3
        from recent r join same_hour h on h.site = r.site and h.unit = r.unit and h.origin = r.origin
        join unit_dim d on d.site = r.site and d.unit = r.unit window w as (partition by r.site, r.origin, h.h)""",
    "mixed": """select *, case when m1 > 0 then 0.5 * coalesce(p_now / m1, 0) else 0 end + case when m2 > 0 then 0.35 * coalesce(p_recent / m2, 0) else 0 end
        + case when m3 > 0 then 0.15 * coalesce(p_hour / m3, 0) else 0 end as mix from parts""",
    "weights": """select site, unit, origin, ts, capacity, case when sum(mix) over w > 0 then mix / sum(mix) over w
        else capacity / sum(capacity) over w end as weight from mixed window w as (partition by site, ts)""",
    "demand": "select site, ts, lag(total, 24) over (partition by site order by ts) * 1.6 as total from site_series",
    "fill0": """select w.site, w.unit, w.ts, w.capacity, w.capacity as cap, w.weight, 0.0::double as alloc, true as active,
        least(greatest(d.total, 0), sum(w.capacity) over (partition by w.site, w.ts)) as t
        from weights w join demand d on d.site = w.site and d.ts = w.ts""",
    **{f"fill{i + 1}": f"select site, unit, ts, capacity, cap, weight, alloc2 as alloc, active2 as active, t from ({_round(i)})" for i in range(ROUNDS)},
    "placed": f"""select f.site, f.unit, f.ts, f.capacity, f.alloc as base_mw, l.available, case when l.available = 0 then 0 else f.alloc end as mw
        from fill{ROUNDS} f join plan_last l on l.site = f.site and l.unit = f.unit and l.ts = f.ts""",
}


def last_plan(spark, sf, p=None):
    p = X.panel(spark, sf) if p is None else p
    return I.outage_plan_last_known(p.select("site", "unit", "ts", "available"), X.origins(spark, sf))


def same_day_plan(spark, sf):
    u = X.unit_readings(spark, sf)
    recorded = u.withColumn("available", F.when(F.col("mw") > 0, 1).otherwise(0))
    return I.outage_plan_informed(u.select("site", "unit").distinct(), recorded, X.origins(spark, sf))


@REG.add("outage_plan_last_known", "select site, unit, origin, ts, available from plan_last", OUT)
def outage_plan_last_known(spark, sf):
    return last_plan(spark, sf)


@REG.add("outage_plan_informed", "select site, unit, origin, ts, available from plan_same", OUT)
def outage_plan_informed(spark, sf):
    return same_day_plan(spark, sf)


CAPS = {
    "cap_last": """select l.site, l.ts, sum(case when l.available > 0 then d.capacity else 0 end) as base
        from plan_last l join unit_dim d on d.site = l.site and d.unit = l.unit group by all""",
    "cap_panel": """select p.site, p.ts, sum(case when p.available > 0 then d.capacity else 0 end) as plan
        from panel p join unit_dim d on d.site = p.site and d.unit = p.unit group by all""",
}


@REG.add("availability_ratio", f"""select b.site, b.ts, {r6s('case when plan <= 0 then 0.0 when base <= 0 then plan / s.capacity else plan / base end')} as ratio
    from cap_last b join cap_panel p on p.site = b.site and p.ts = b.ts join site_dim s on s.site = b.site""", OUT | CAPS)
def availability_ratio(spark, sf):
    p = X.stored_panel(spark, sf)
    return rounded(I.availability_ratio(last_plan(spark, sf, p), p.select("site", "unit", "ts", "available"), X.unit_dim(spark, sf), X.site_dim(spark, sf)))


@REG.add("available_capacity", f"select site, ts, {r6s('plan')} as available_capacity from cap_panel", CAPS)
def available_capacity(spark, sf):
    return rounded(I.available_capacity(X.panel(spark, sf), X.unit_dim(spark, sf)))


@REG.add("unit_shares", f"select site, unit, ts, {r6s('share')} as share from shares", OUT)
def unit_shares(spark, sf):
    return rounded(I.unit_shares(filled_panel(spark, sf)))


@REG.add("learned_weights", f"select site, unit, origin, ts, {r6s('weight')} as weight from weights", OUT)
def learned_weights(spark, sf):
    return rounded(I.learned_weights(filled_panel(spark, sf), X.unit_dim(spark, sf)).drop("capacity"))


def demand(spark, sf, p):
    """A site forecast that often exceeds single caps: yesterday times 1.6."""
    s = X.site_series(spark, sf, p)
    return s.select("site", "ts", (G.seasonal_naive("total", ["site"], 24) * 1.6).alias("total"))


def allocation_rows(spark, sf, p):
    w = I.learned_weights(X.filled(p), X.unit_dim(spark, sf))
    return w.join(demand(spark, sf, p), ["site", "ts"])


@REG.add("allocate_with_caps", f"select site, unit, ts, {r6s('alloc')} as mw from fill{ROUNDS}", OUT)
def allocate_with_caps(spark, sf):
    return rounded(I.allocate_with_caps(allocation_rows(spark, sf, X.stored_panel(spark, sf))).select("site", "unit", "ts", "mw"))


def placed(spark, sf):
    p = X.stored_panel(spark, sf)
    plan = last_plan(spark, sf, p).select("site", "unit", "ts", "available")
    return I.apply_outage(allocation_rows(spark, sf, p).join(plan, ["site", "unit", "ts"]))


@REG.add("apply_outage", f"select site, unit, ts, {r6s('mw')} as mw, {r6s('base_mw')} as base_mw from placed", OUT)
def apply_outage(spark, sf):
    return rounded(placed(spark, sf).select("site", "unit", "ts", "mw", "base_mw"))


@REG.add("reconcile_totals", f"""select ts, site, unit, case when grouping(site) = 1 then 'cascade' when grouping(unit) = 1 then 'site' else 'unit' end as level,
    {r6s('sum(case when available <= 0 then 0 else least(greatest(base_mw * 1.02, 0), capacity) end)')} as mw
    from placed group by grouping sets ((ts, site, unit), (ts, site), (ts))""", OUT)
def reconcile_totals(spark, sf):
    raw = placed(spark, sf).withColumn("mw", F.col("base_mw") * 1.02)
    return rounded(I.reconcile_totals(raw).select("ts", "site", "unit", "level", "mw"))


VIOLATIONS = {
    "vu": """select site, unit, ts, base_mw as mw, available as st, lag(available) over (partition by site, unit order by ts) as was from placed""",
    "vs": "select site, ts, sum(mw) as total from placed group by all",
    "vt": "select site, ts, sum(mw) as s, count(*) filter (mw > 1e-6) as n, min(mw) filter (mw > 1e-6) as low, max(mw) filter (mw > 1e-6) as high from vu group by all",
}


@REG.add("validate_outage_effect", f"""select kind, site, unit, ts, {r6s('amount')} as amount from (
    select 'generation_while_out' as kind, site, unit, ts, mw as amount from vu where st <= 0 and abs(mw) > 1e-6
    union all select 'zero_after_return', vu.site, vu.unit, vu.ts, mw from vu join vs on vs.site = vu.site and vs.ts = vu.ts
      where was <= 0 and st > 0 and mw <= 1e-6 and total > 1e-6
    union all select 'site_total_mismatch', vt.site, null, vt.ts, total - s from vt join vs on vs.site = vt.site and vs.ts = vt.ts where abs(total - s) > 1e-6
    union all select 'identical_active_units', site, null, ts, high from vt where n > 1 and high - low <= 1e-6
    union all select 'cascade_total_mismatch', null, null, ts, -1.0 from (select distinct ts from vs))""", OUT | VIOLATIONS)
def validate_outage_effect(spark, sf):
    # Feed values from before the outage, and a cascade total that is 1 MW short.
    p = cut_lineage(placed(spark, sf))
    totals = p.groupBy("site", "ts").agg(F.sum("mw").alias("total"))
    cascade = totals.groupBy("ts").agg((F.sum("total") - 1.0).alias("total"))
    return rounded(I.validate_outage_effect(p.withColumn("mw", F.col("base_mw")), totals, cascade))


@REG.add("outage_summary", """select cast(sum(n0) as bigint) as unavailable_hours, cast(sum(n1) as bigint) as available_hours,
    count(*) filter (n0 > 0) as affected_units, count(distinct case when n0 > 0 then site end) as affected_sites,
    string_agg(distinct case when n0 > 0 then site end, ',' order by case when n0 > 0 then site end) as sites
    from (select site, unit, count(*) filter (available <= 0) as n0, count(*) filter (available > 0) as n1 from plan_last group by all)""", OUT)
def outage_summary(spark, sf):
    return I.outage_summary(last_plan(spark, sf))
