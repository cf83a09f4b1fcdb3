"""Registered queries: cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import r6
from ..operators import cleaning as C
from ..session import cut_lineage
from . import fixtures as X
from .fixtures import r6s
from .registry import Registry

REG = Registry()
UNIT = ["site", "unit"]


# --- SQL building blocks ---------------------------------------------------

def sql_smooth(name: str, src: str, keys: list[str], value: str) -> dict[str, str]:
    k, same = ", ".join(keys), " and ".join(f"x.{c} = r.{c}" for c in keys)
    xk = ", ".join(f"x.{c}" for c in keys)
    return {
        f"{name}_x": f"""select {k}, ts, {value} as x, lead({value}) over w as nx,
            row_number() over w as i from {src} window w as (partition by {k} order by ts)""",
        f"{name}_y": f"""select {k}, ts, i, x as y from {name}_x where i = 1 /* recursive_step */ union all
            select {xk}, x.ts, x.i, case when r.y is not null and x.x is not null and x.nx is not null
              and abs(x.x - (r.y + x.nx) / 2) > {S.SPIKE_FACTOR} * greatest(abs(r.y - x.nx) + 1e-6, 1)
              then (r.y + x.nx) / 2 else x.x end
            from {name}_y r join {name}_x x on {same} and x.i = r.i + 1""",
        name: f"select {k}, ts, y as {value} from {name}_y",
    }


def sql_interpolate(name: str, src: str, keys: list[str], value: str, limit: int | None) -> dict[str, str]:
    k = ", ".join(keys)
    near = "true" if limit is None else f"(coalesce(p - ai <= {limit}, false) or coalesce(bi - p <= {limit}, false))"
    return {
        f"{name}_p": f"select *, cast(epoch(ts) / 3600 as bigint) as p from {src}",
        f"{name}_w": f"""select {k}, ts, {value}, p,
            last_value({value} ignore nulls) over back as a,
            last_value(case when {value} is not null then p end ignore nulls) over back as ai,
            last_value({value} ignore nulls) over ahead as z,
            last_value(case when {value} is not null then p end ignore nulls) over ahead as bi
            from {name}_p window back as (partition by {k} order by ts rows unbounded preceding),
            ahead as (partition by {k} order by ts desc rows unbounded preceding)""",
        name: f"""select {k}, ts, case when {value} is not null then {value} when {near} then
            coalesce(a + (z - a) * (cast(p - ai as double) / (bi - ai)), a, z) end as {value} from {name}_w""",
    }


def sql_blank_zero_runs(name: str, src: str, keys: list[str], value: str) -> dict[str, str]:
    k = ", ".join(keys)
    return {
        f"{name}_z": f"select {k}, ts, {value}, coalesce({value} = 0, false) as z from {src}",
        f"{name}_n": f"""select *, row_number() over (partition by {k} order by ts)
            - row_number() over (partition by {k}, z order by ts) as g from {name}_z""",
        name: f"""select {k}, ts, case when z and count(*) over (partition by {k}, z, g) <= {S.SHORT_ZERO_RUN}
            then null else {value} end as {value} from {name}_n""",
    }


def sql_rule(name: str, src: str, keys: list[str], value: str, rule: str) -> dict[str, str]:
    return {name: f"select {', '.join(keys)}, ts, {rule} as {value} from {src}"}


NEAR_ZERO = "case when {v} <= 0.05 then 0.0 else {v} end"
NEGATIVE = "case when {v} < 0 then 0.0 else {v} end"


def sql_generation(out: str, src: str, keys: list[str], v: str) -> dict[str, str]:
    return (
        sql_rule(f"{out}_1", src, keys, v, NEAR_ZERO.format(v=v)) | sql_smooth(f"{out}_2", f"{out}_1", keys, v)
        | sql_interpolate(f"{out}_3", f"{out}_2", keys, v, S.SHORT_GAP) | sql_blank_zero_runs(f"{out}_4", f"{out}_3", keys, v)
        | sql_interpolate(f"{out}_5", f"{out}_4", keys, v, None) | sql_rule(out, f"{out}_5", keys, v, NEAR_ZERO.format(v=v))
    )


def sql_gate(out: str, src: str, keys: list[str], v: str) -> dict[str, str]:
    return (
        sql_rule(f"{out}_1", src, keys, v, NEGATIVE.format(v=v)) | sql_smooth(f"{out}_2", f"{out}_1", keys, v)
        | sql_interpolate(f"{out}_3", f"{out}_2", keys, v, S.SHORT_GAP) | sql_blank_zero_runs(f"{out}_4", f"{out}_3", keys, v)
        | sql_interpolate(out, f"{out}_4", keys, v, None)
    )


def sql_level(out: str, src: str, keys: list[str], v: str) -> dict[str, str]:
    return sql_smooth(f"{out}_1", src, keys, v) | sql_interpolate(out, f"{out}_1", keys, v, S.SHORT_GAP)


def unit_out(df, value="mw"):
    return df.select("site", "unit", "ts", r6(value).alias(value))


UNIT_OUT = f"select site, unit, ts, {r6s('mw')} as mw from out"

# Deviation from 25 MW: a signal with negative values for the gate rules.
SIGNED = {"signed": "select site, unit, ts, mw - 25 as mw from panel"}


def signed(spark, sf):
    return X.panel(spark, sf).select("site", "unit", "ts", (F.col("mw") - 25).alias("mw"))


# --- queries ---------------------------------------------------------------

@REG.add("run_lengths", """select site, unit, min(i) as run_start, max(i) as run_end, count(*) as run_length from (
    select site, unit, i, i - row_number() over (partition by site, unit order by i) as g from (
      select site, unit, available, row_number() over (partition by site, unit order by ts) - 1 as i from panel)
    where available = 0) group by site, unit, g""")
def run_lengths(spark, sf):
    down = X.panel(spark, sf).withColumn("down", F.col("available") == 0)
    w = C.run_lengths(down, UNIT, "down")
    return w.select(*UNIT, F.col("run_start").cast("bigint"), F.col("run_end").cast("bigint"), "run_length")


@REG.add("clamp_near_zero", UNIT_OUT, sql_rule("out", "panel", UNIT, "mw", "case when mw - 25 <= 0.05 then 0.0 else mw - 25 end"))
def clamp_near_zero(spark, sf):
    return unit_out(signed(spark, sf).withColumn("mw", C.clamp_near_zero("mw")))


@REG.add("clamp_negative", UNIT_OUT, SIGNED | sql_rule("out", "signed", UNIT, "mw", NEGATIVE.format(v="mw")))
def clamp_negative(spark, sf):
    return unit_out(signed(spark, sf).withColumn("mw", C.clamp_negative("mw")))


@REG.add("smooth_spikes", UNIT_OUT, sql_smooth("out", "panel", UNIT, "mw"))
def smooth_spikes(spark, sf):
    return unit_out(C.smooth_spikes(X.panel(spark, sf), UNIT, "mw"))


@REG.add("interpolate_short", UNIT_OUT, sql_interpolate("out", "panel", UNIT, "mw", S.SHORT_GAP))
def interpolate_short(spark, sf):
    return unit_out(C.interpolate(X.panel(spark, sf), UNIT, "mw", limit=S.SHORT_GAP))


ZEROED = {"zeroed": "select site, unit, ts, case when mw < 12 then 0.0 else coalesce(mw, 0) end as mw from panel"}


@REG.add("interpolate_zero_runs", UNIT_OUT,
         ZEROED | sql_blank_zero_runs("blank", "zeroed", UNIT, "mw") | sql_interpolate("out", "blank", UNIT, "mw", None))
def interpolate_zero_runs(spark, sf):
    low = F.when(F.col("mw") < 12, 0.0).otherwise(F.coalesce("mw", F.lit(0.0)))
    return unit_out(C.interpolate_zero_runs(X.panel(spark, sf).withColumn("mw", low), UNIT, "mw"))


@REG.add("clean_generation", UNIT_OUT, sql_generation("out", "panel", UNIT, "mw"))
def clean_generation(spark, sf):
    return unit_out(C.clean_generation(X.panel(spark, sf), UNIT))


@REG.add("clean_gate", UNIT_OUT, SIGNED | sql_gate("out", "signed", UNIT, "mw"))
def clean_gate(spark, sf):
    return unit_out(C.clean_gate(signed(spark, sf), UNIT, "mw"))


@REG.add("clean_level", f"select site, ts, {r6s('level')} as level from out", sql_level("out", "level_grid", ["site"], "level"))
def clean_level(spark, sf):
    done = C.clean_level(X.level_grid(spark, sf), ["site"], "level")
    return done.select("site", "ts", r6("level").alias("level"))


CHANNELS = ["unit1", "unit2", "unit3", "level"]


def channel_rows(spark, sf):
    """One row per site and hour: three unit channels and the level channel."""
    w = X.unit_readings(spark, sf).groupBy("site", "ts").agg(
        *[F.max(F.when(F.col("unit") == u, F.col("mw"))).alias(u) for u in CHANNELS[:3]]
    )
    return w.join(X.level(spark, sf), ["site", "ts"])


KNN = {
    "wide": """select u.site, u.ts, max(case when unit = 'unit1' then mw end) as c0, max(case when unit = 'unit2' then mw end) as c1,
        max(case when unit = 'unit3' then mw end) as c2, max(level) as c3
        from u join level l on l.site = u.site and l.ts = u.ts group by all""",
    "cells": "select site, ts, [c0, c1, c2, c3] as v from wide",
    "pairs": """select h.site, h.ts as target, d.ts as donor, h.v as t, d.v as d,
        list_filter([(h.v[i] - d.v[i]) * (h.v[i] - d.v[i]) for i in [1, 2, 3, 4]], lambda e : e is not null) as sq
        from cells h join cells d on d.site = h.site where len(list_filter(h.v, lambda e : e is null)) > 0""",
    "dist": "select *, sqrt(list_sum(sq) * 4 / len(sq)) as dist from pairs where len(sq) > 0",
    "near": """select site, target, c, d[c] as value, dist,
        row_number() over (partition by site, target, c order by dist, donor) as rank
        from (select *, unnest([1, 2, 3, 4]) as c from dist) where t[c] is null and d[c] is not null""",
    "filled": """select site, target, c, coalesce(avg(case when dist = 0 then value end),
        sum(value / nullif(dist, 0)) / sum(1.0 / nullif(dist, 0))) as f from near where rank <= 5 group by all""",
    "means": "select site, avg(c0) as m0, avg(c1) as m1, avg(c2) as m2, avg(c3) as m3 from wide group by site",
}


@REG.add("knn_impute", "select w.site, w.ts, " + ", ".join(
    f"{r6s(f'coalesce(w.c{i}, (select f from filled f where f.site = w.site and f.target = w.ts and f.c = {i + 1}), m.m{i})')} as {n}"
    for i, n in enumerate(CHANNELS)) + " from wide w join means m on m.site = w.site", KNN)
def knn_impute(spark, sf):
    done = C.knn_impute(cut_lineage(channel_rows(spark, sf)), ["site"], CHANNELS)
    return done.select("site", "ts", *[r6(c).alias(c) for c in CHANNELS])


@REG.add("derive_total", f"select site, ts, {r6s('total')} as total from site_series")
def derive_total(spark, sf):
    return C.derive_total(X.panel(spark, sf)).select("site", "ts", r6("total").alias("total"))


STATUS = {"status": """select distinct event_type as site, 'unit' || cast(user_id % 3 + 1 as varchar) as unit,
    case when event_type = 'click' then user_id % 2 else 0 end as channel from events where user_id % 3 < 2"""}


@REG.add("derive_status", """select p.site, p.unit, p.ts, cast(case when c.n = 1 then case when p.mw > 0 then 1 else 0 end end as integer) as available
    from panel p left join (select site, unit, count(*) as n from status group by all) c on c.site = p.site and c.unit = p.unit""", STATUS)
def derive_status(spark, sf):
    e = X.events(spark, sf).where(F.col("user_id") % 3 < 2)
    status = e.select(
        F.col("event_type").alias("site"), F.concat(F.lit("unit"), (F.col("user_id") % 3 + 1).cast("string")).alias("unit"),
        F.when(F.col("event_type") == "click", F.col("user_id") % 2).otherwise(0).alias("channel"),
    ).distinct()
    return C.derive_status(X.panel(spark, sf), status)


@REG.add("binarize_status", "select site, unit, ts, available from panel")
def binarize_status(spark, sf):
    return X.panel(spark, sf).select("site", "unit", "ts", C.binarize_status("mw").alias("available"))


MEANS = {
    "hm": """select event_type as site, date_trunc('hour', ts) as ts, avg(value) as value,
        avg(case when value > 20 then 1.0 else 0.0 end) as running from events group by all""",
    "hs": "select distinct event_type as site from events",
    "hmean": """select hs.site, spine.ts, hm.value, hm.running from hs cross join spine
        left join hm on hm.site = hs.site and hm.ts = spine.ts""",
}


def hourly_mean(spark, sf):
    e = X.events(spark, sf).select(
        F.col("event_type").alias("site"), "ts", "value", F.when(F.col("value") > 20, 1.0).otherwise(0.0).alias("running")
    )
    return C.resample_hourly_mean(e, ["site"], ["value", "running"])


@REG.add("resample_hourly_mean", f"select site, ts, {r6s('value')} as value from hmean", MEANS)
def resample_hourly_mean(spark, sf):
    return hourly_mean(spark, sf).select("site", "ts", r6("value").alias("value"))


@REG.add("resample_status_majority", "select site, ts, case when running >= 0.5 then 1 else 0 end as available from hmean", MEANS)
def resample_status_majority(spark, sf):
    return hourly_mean(spark, sf).select("site", "ts", C.resample_status_majority("running").alias("available"))


@REG.add("hour_number", "select site, ts, cast(ts as date) as date, cast(hour(ts) + 1 as integer) as time from site_series")
def hour_number(spark, sf):
    return X.site_series(spark, sf).select("site", "ts", F.to_date("ts").alias("date"), C.hour_number().alias("time"))


@REG.add("daily_consistency", """select cast(ts as date) as d, count(distinct level) as distinct_values
    from level group by 1 having count(distinct level) > 1""")
def daily_consistency(spark, sf):
    return C.daily_consistency(X.level(spark, sf), "level")


@REG.add("outage_template", """select site, unit, cast(h as integer) as h, (select max(ts) from panel) + h * interval 1 hour as ts,
    available from (select site, unit, arg_max(available, ts) as available, unnest(generate_series(1, 24)) as h
    from panel group by site, unit)""")
def outage_template(spark, sf):
    return C.outage_template(X.panel(spark, sf))
