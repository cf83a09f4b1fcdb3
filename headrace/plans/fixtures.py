"""The test tables seen as a panel: events -> units -> sites.

site = event type, unit = user_id % 3 + 1, MW = hourly sum of ``value``.
Every table comes with the SQL that the DuckDB side uses for it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import hour_floor
from ..operators import baselines, cleaning, splits
from ..session import cut_lineage, tune

CHAIN = {"view": "click", "signup": "view", "purchase": "signup", "error": "purchase"}
ORDER = ["click", "view", "signup", "purchase", "error"]
SITES = [(site, CHAIN.get(site), i + 1) for i, site in enumerate(ORDER)]

TRAIN_DAYS, VALIDATION_DAYS = 21, 25


_SCHEMAS: dict = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A test table; its footer is read once, later reads pass the schema along."""
    tune(spark)
    path = f"{sf_dir}/{table}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def events(spark, sf):
    return read(spark, sf, "events")


def unit_readings(spark, sf) -> DataFrame:
    """Hourly MW per reporting unit; sums are decimal, hence exact."""
    e = events(spark, sf)
    unit = F.concat(F.lit("unit"), (F.col("user_id") % 3 + 1).cast("string"))
    return e.groupBy(F.col("event_type").alias("site"), unit.alias("unit"), hour_floor("ts").alias("ts")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("mw")
    )


def panel(spark, sf) -> DataFrame:
    grid = cleaning.complete_grid(unit_readings(spark, sf), ["site", "unit"])
    return grid.withColumn("available", cleaning.binarize_status("mw"))


def stored_panel(spark, sf) -> DataFrame:
    """The panel as a written table, for queries that read it several times."""
    return cut_lineage(panel(spark, sf))


def filled(p: DataFrame) -> DataFrame:
    """A panel whose silent hours count as zero output."""
    return p.withColumn("mw", F.coalesce("mw", F.lit(0.0)))


def site_series(spark, sf, p: DataFrame | None = None) -> DataFrame:
    return (panel(spark, sf) if p is None else p).groupBy("site", "ts").agg(
        F.sum(F.coalesce("mw", F.lit(0.0)).cast("decimal(18,2)")).cast("double").alias("total"),
        F.sum("available").alias("units_running"),
    )


def unit_dim(spark, sf, p: DataFrame | None = None) -> DataFrame:
    return (unit_readings(spark, sf) if p is None else p).groupBy("site", "unit").agg(F.max("mw").alias("capacity"))


def site_dim(spark, sf, p: DataFrame | None = None) -> DataFrame:
    """Capacity, upstream site and ordinal; one row per site."""
    cap = unit_dim(spark, sf, p).groupBy("site").agg(
        F.sum(F.col("capacity").cast("decimal(18,2)")).cast("double").alias("capacity")
    )
    place = F.create_map(*[F.lit(x) for site, _, i in SITES for x in (site, i)])
    above = F.create_map(*[F.lit(x) for site, up, _ in SITES if up for x in (site, up)])
    return cap.select(
        "site", "capacity", F.try_element_at(above, F.col("site")).alias("upstream_site"), F.try_element_at(place, F.col("site")).alias("ordinal")
    )


def level(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return events(spark, sf).groupBy(F.col("event_type").alias("site"), hour_floor("ts").alias("ts")).agg(
        (F.sum(k).cast("double") / F.count(F.lit(1))).alias("level")
    )


def level_grid(spark, sf) -> DataFrame:
    return cleaning.complete_grid(level(spark, sf), ["site"])


def daily_context(spark, sf) -> DataFrame:
    return level(spark, sf).groupBy(F.to_date("ts").alias("d")).agg(F.min("level").alias("rain"))


def bounds(spark, sf, p: DataFrame | None = None) -> DataFrame:
    e = events(spark, sf) if p is None else p
    return e.agg(hour_floor(F.min("ts")).alias("lo"), hour_floor(F.max("ts")).alias("hi"))


def cuts(spark, sf, p: DataFrame | None = None):
    """Cut timestamps: 21 training days, 4 validation days, the rest testing."""
    day0 = F.to_date(bounds(spark, sf, p).select("lo").scalar())
    at = lambda n: F.date_add(day0, n).cast("timestamp_ntz")
    return at(TRAIN_DAYS), at(VALIDATION_DAYS)


def origins(spark, sf) -> DataFrame:
    """Every full day after the first, as a midnight timestamp.

    One row per day, written once: plans and as-of joins refer to it repeatedly.
    """
    days = splits.full_days(site_series(spark, sf))
    first = F.to_date(bounds(spark, sf).select("lo").scalar())
    return cut_lineage(days.where(F.col("d") > first).select(F.col("d").cast("timestamp_ntz").alias("origin")))


def predictions(spark, sf, p: DataFrame | None = None) -> DataFrame:
    """Three baseline models wherever they have a value, with capacity and split."""
    v, t = cuts(spark, sf, p)
    base = baselines.baseline_predictions(site_series(spark, sf, p), ["site"])
    return (
        base.join(site_dim(spark, sf, p).select("site", "capacity", "ordinal"), "site")
        .select(
            "model", "site", "ordinal", "capacity", F.to_date("ts").alias("forecast_date"),
            (F.hour("ts") + 1).alias("forecast_hour"), "ts", "actual", "predicted",
            splits.cut_split("ts", v, t).alias("split"),
        )
    )


def stored_predictions(spark, sf) -> DataFrame:
    """Predictions as a written table, the way a backtest leaves them."""
    return cut_lineage(predictions(spark, sf, stored_panel(spark, sf)))


def forecasts(spark, sf) -> DataFrame:
    """All 24 h forecasts: day, model, hour, site, MW. A day a model covers in part is no forecast."""
    p = stored_predictions(spark, sf)
    whole = F.count(F.lit(1)).over(Window.partitionBy("forecast_date", "model", "site")) == S.HORIZON
    return p.withColumn("_whole", whole).where("_whole").select(
        "forecast_date", "model", "site", "ordinal", "capacity", "forecast_hour", "ts", "actual", F.col("predicted").alias("mw")
    )


# --- the same tables in DuckDB --------------------------------------------

_case = lambda pairs: " ".join(f"when '{a}' then {b}" for a, b in pairs)

CTES: dict[str, str] = {
    "u": """select event_type as site, 'unit' || cast(user_id % 3 + 1 as varchar) as unit, date_trunc('hour', ts) as ts,
        cast(sum(cast(value as decimal(18,2))) as double) as mw from events group by all""",
    "b": "select min(ts) as lo, max(ts) as hi from u",
    "spine": "select unnest(generate_series(lo, hi, interval 1 hour)) as ts from b",
    "su": "select distinct site, unit from u",
    "panel": """select su.site, su.unit, spine.ts, u.mw, case when u.mw > 0 then 1 else 0 end as available
        from su cross join spine left join u on u.site = su.site and u.unit = su.unit and u.ts = spine.ts""",
    "site_series": """select site, ts, cast(sum(cast(coalesce(mw, 0) as decimal(18,2))) as double) as total,
        cast(sum(available) as bigint) as units_running from panel group by all""",
    "unit_dim": "select site, unit, max(mw) as capacity from u group by all",
    "site_dim": f"""select site, cast(sum(cast(capacity as decimal(18,2))) as double) as capacity,
        case site {_case((a, f"'{b}'") for a, b in CHAIN.items())} end as upstream_site,
        cast(case site {_case((s, i) for s, _, i in SITES)} end as integer) as ordinal from unit_dim group by site""",
    "level": """select event_type as site, date_trunc('hour', ts) as ts,
        cast(sum(try_cast(json_extract_string(props, '$.k') as bigint)) as double) / count(*) as level
        from events group by all""",
    "ls": "select distinct site from level",
    "lb": "select min(ts) as lo, max(ts) as hi from level",
    "lspine": "select unnest(generate_series(lo, hi, interval 1 hour)) as ts from lb",
    "level_grid": """select ls.site, lspine.ts, l.level from ls cross join lspine
        left join level l on l.site = ls.site and l.ts = lspine.ts""",
    "daily_context": "select cast(ts as date) as d, min(level) as rain from level group by 1",
    "day0": "select cast(min(lo) as date) as d0 from b",
    "full_days": "select cast(ts as date) as d from site_series group by 1 having count(distinct ts) = 24",
    "origins": "select cast(d as timestamp) as origin from full_days, day0 where d > d0",
    "base": """select site, ts, total as actual,
        last_value(case when hour(ts) = 23 then total end ignore nulls) over
          (partition by site order by ts rows between 24 preceding and 1 preceding) as persistence,
        lag(total, 24) over (partition by site order by ts) as naive24,
        lag(total, 168) over (partition by site order by ts) as naive168 from site_series""",
    "tall": """select site, ts, actual, 'persistence' as model, persistence as predicted from base
        union all select site, ts, actual, 'naive24', naive24 from base
        union all select site, ts, actual, 'naive168', naive168 from base""",
    "predictions": f"""select t.model, t.site, d.ordinal, d.capacity, cast(t.ts as date) as forecast_date,
        cast(hour(t.ts) + 1 as integer) as forecast_hour, t.ts, t.actual, t.predicted,
        case when t.ts < day0.d0 + interval {TRAIN_DAYS} day then 'train'
             when t.ts < day0.d0 + interval {VALIDATION_DAYS} day then 'validation' else 'testing' end as split
        from tall t join site_dim d on d.site = t.site cross join day0
        where t.predicted is not null""",
    "forecasts": """select forecast_date, model, site, ordinal, capacity, forecast_hour, ts, actual, predicted as mw from predictions
        qualify count(*) over (partition by forecast_date, model, site) = 24""",
}


def thr(cap: str = "capacity") -> str:
    return f"greatest(1.0, 0.01 * {cap})"


def metric_sql(y: str = "actual", p: str = "predicted", cap: str = "capacity") -> str:
    """The four metrics as select items named like the Spark side."""
    return f"""100 * avg(case when abs({y}) >= {thr(cap)} then abs({y} - {p}) / abs({y}) end) as operational_mape,
        avg(abs({y} - {p})) as mae, sqrt(avg(({y} - {p}) * ({y} - {p}))) as rmse,
        case when count(*) <= 1 then null when var_pop({y}) > 0
          then 1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*))
          when sum(({y} - {p}) * ({y} - {p})) = 0 then 1.0 else 0.0 end as r2"""


def score_sql(weight: float = S.R2_WEIGHT_PRIMARY, out: str = "s") -> str:
    """Four rounded score parts s1..s4 over columns of :func:`metric_sql`."""
    m, q = "coalesce(operational_mape, cast('inf' as double))", "coalesce(r2, -999.0)"
    total = f"{m} + rmse + (1 - {q}) * {weight} + greatest(0.0, -({q})) * {S.NEGATIVE_R2_PENALTY}"
    fine = lambda x: f"case when isinf({x}) then {x} else round({x}, 9) end"
    return f"{fine(total)} as s1, round(-({q}), 9) as s2, {fine(m)} as s3, round(rmse, 9) as s4"


def r6s(expr: str) -> str:
    return f"round(({expr}) + 1e-9, 6) + 0.0"


def rows_sql(select: str, columns: list[str]) -> str:
    """Round the named columns of a select to six decimals, pass the others."""
    rep = ", ".join(f"{r6s(c)} as {c}" for c in columns)
    return f"select * replace ({rep}) from ({select})"


def query(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the tables it names, directly or through others."""
    defs = {**CTES, **(extra or {})}
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in defs:
            # A definition may carry a column list: "grid(k, w)" is used as "grid".
            if name not in need and re.search(rf"\b{name.split('(')[0]}\b", text):
                need.add(name)
                todo.append(defs[name])
    chosen = [n for n in defs if n in need]
    if not chosen:
        return body
    recursive = "recursive " if any("recursive_step" in defs[n] for n in chosen) else ""
    return f"with {recursive}" + ",\n".join(f"{n} as ({defs[n]})" for n in chosen) + "\n" + body
