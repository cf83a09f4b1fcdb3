"""Registered queries: naming, reshaping, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import metric_columns, r6, series_window
from ..operators import features as E
from ..operators import naming as N
from ..operators import splits as P
from ..sources import store, tables
from . import fixtures as X
from .fixtures import metric_sql, r6s, rows_sql
from .q_features import BACKTEST, rounded
from .registry import Registry

REG = Registry()
SITES = X.ORDER
UNITS = ["unit1", "unit2", "unit3"]
TOTALS = [f"total_gen_{s}" for s in SITES]


def sql_sanitize(x: str) -> str:
    t = rf"lower(regexp_replace({x}, '^\s+|\s+$', '', 'g'))"
    return rf"nullif(regexp_replace(regexp_replace(regexp_replace({t}, '\s+', '_', 'g'), '[-/]', '_', 'g'), '[().:]', '', 'g'), '')"


NUM = rf"'{N.NUMBER}'"


def sql_number(x: str) -> str:
    return f"case when regexp_matches({x}, {NUM}) then try_cast(trim({x}) as double) end"


def unit_no():
    return (F.col("user_id") % 3 + 1).cast("string")


# --- names -----------------------------------------------------------------

@REG.add("sanitize_name", f"""select raw_name, {sql_sanitize('raw_name')} as name, count(*) as n from (
    select 'Gen - ' || event_type || ' / Unit ' || (user_id % 3 + 1) as raw_name from events
    union all select url from pages union all select '  ' from region) group by all""")
def sanitize_name(spark, sf):
    raw = X.events(spark, sf).select(
        F.concat(F.lit("Gen - "), "event_type", F.lit(" / Unit "), unit_no()).alias("raw_name")
    )
    more = X.read(spark, sf, "pages").select(F.col("url").alias("raw_name"))
    blank = X.read(spark, sf, "region").select(F.lit("  ").alias("raw_name"))
    names = raw.unionAll(more).unionAll(blank).groupBy("raw_name").agg(F.count(F.lit(1)).alias("n"))
    return names.select("raw_name", N.sanitize_name("raw_name").alias("name"), "n")


HEADERS = {
    "cells": """select l_orderkey as sheet, pos, case when pos in (1, 4) then 'Line ' || l_returnflag end as l1,
        case when pos in (1, 3, 5) then l_linestatus || ' (MW)' end as l2,
        case when pos = 2 then 'Date' when l_quantity < 25 then 'Unit ' || (l_partkey % 3) end as l3
        from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos
          from lineitem)""",
    "carried": f"""select sheet, pos, {sql_sanitize('last_value(l1 ignore nulls) over w')} as a,
        {sql_sanitize('last_value(l2 ignore nulls) over w')} as b, {sql_sanitize('l3')} as c from cells
        window w as (partition by sheet order by pos rows unbounded preceding)""",
    "labels": """select sheet, pos, case when 'date' in (a, b, c) then 'date' when 'time' in (a, b, c) then 'time'
        when coalesce(a, b, c) is null then 'unnamed' else concat_ws('_', a, b, c) end as label from carried""",
}


def header_cells(spark, sf):
    w = series_window(["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    p = X.read(spark, sf, "lineitem").withColumn("pos", F.row_number().over(w).cast("bigint"))
    return p.select(
        F.col("l_orderkey").alias("sheet"), "pos",
        F.when(F.col("pos").isin(1, 4), F.concat(F.lit("Line "), "l_returnflag")).alias("l1"),
        F.when(F.col("pos").isin(1, 3, 5), F.concat("l_linestatus", F.lit(" (MW)"))).alias("l2"),
        F.when(F.col("pos") == 2, "Date").when(F.col("l_quantity") < 25, F.concat(F.lit("Unit "), (F.col("l_partkey") % 3).cast("string"))).alias("l3"),
    )


@REG.add("ffill_labels", "select sheet, pos, label from labels", HEADERS)
def ffill_labels(spark, sf):
    return N.ffill_labels(header_cells(spark, sf), "sheet", "pos", ["l1", "l2", "l3"])


@REG.add("suffix_repeats", """select sheet, pos, case when k = 0 then label else label || '_' || k end as label from (
    select *, row_number() over (partition by sheet, label order by pos) - 1 as k from labels)""", HEADERS)
def suffix_repeats(spark, sf):
    labels = N.ffill_labels(header_cells(spark, sf), "sheet", "pos", ["l1", "l2", "l3"])
    return N.suffix_repeats(labels, "sheet", "pos", "label")


def metric_names(spark, sf):
    kind, s, u = F.col("user_id") % 4, F.col("event_type"), unit_no()
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    raw = (
        F.when(kind == 0, text("Generated MW - Gen ", s, " Gen ", s, " Unit ", u))
        .when(kind == 1, text("Outage of Plants / Out ", s, " ", s, " Unit", u))
        .when(kind == 2, text("Generated MW Gen ", s, " Total Gen ", s))
        .otherwise(text("Daily Rainfall (mm) ", s))
    )
    return X.events(spark, sf).groupBy(raw.alias("raw_name")).agg(F.count(F.lit(1)).alias("n"))


@REG.add("parse_metric_name", """select case kind when 0 then 'Generated MW - Gen ' || s || ' Gen ' || s || ' Unit ' || u
      when 1 then 'Outage of Plants / Out ' || s || ' ' || s || ' Unit' || u
      when 2 then 'Generated MW Gen ' || s || ' Total Gen ' || s else 'Daily Rainfall (mm) ' || s end as raw_name,
    case kind when 0 then 'gen_' || s || '_unit' || u when 1 then 'out_' || s || '_unit' || u
      when 2 then 'total_gen_' || s else 'rainfall' end as name,
    case kind when 0 then 'gen' when 1 then 'out' when 2 then 'total_gen' else 'rainfall' end as metric,
    case when kind < 3 then s end as site, case when kind < 2 then 'unit' || u end as unit, n
    from (select user_id % 4 as kind, event_type as s, case when user_id % 4 < 2 then user_id % 3 + 1 end as u, count(*) as n
      from events group by all)""")
def parse_metric_name(spark, sf):
    prefixes = [p.replace("generated_mw_", "generated_mw_+") for p in N.GROUP_PREFIXES]
    prefixes = [p.replace("outage_of_plants_", "outage_of_plants_+") for p in prefixes]
    return N.parse_metric_name(metric_names(spark, sf), "raw_name", SITES, prefixes)


@REG.add("entity_from_name", """select event_type as site, 'unit' || (user_id % 3 + 1) as unit,
    'gen_' || event_type || '_unit' || (user_id % 3 + 1) as name, count(*) as n from events group by all""")
def entity_from_name(spark, sf):
    names = X.events(spark, sf).groupBy(
        F.concat(F.lit("gen_"), "event_type", F.lit("_unit"), unit_no()).alias("name")
    ).agg(F.count(F.lit(1)).alias("n"))
    site, unit = N.entity_from_name("name", SITES)
    return names.select("name", site.alias("site"), unit.alias("unit"), "n")


# --- values and time -------------------------------------------------------

@REG.add("coalesce_duplicates", f"""select event_id, coalesce({sql_number("case when user_id < 50 then cast(value as varchar) else 'n/a' end")},
    {sql_number('event_type')}, {sql_number("json_extract_string(props, '$.k')")}) as rain from events""")
def coalesce_duplicates(spark, sf):
    e = X.events(spark, sf).select(
        "event_id", F.when(F.col("user_id") < 50, F.col("value").cast("string")).otherwise("n/a").alias("rain_a"),
        F.col("event_type").alias("rain_b"), F.get_json_object("props", "$.k").alias("rain_c"),
    )
    return e.select("event_id", N.coalesce_duplicates(["rain_a", "rain_b", "rain_c"]).alias("rain"))


@REG.add("coerce_numeric", f"""select doc_id, {sql_number('t')} as value, {sql_number('n')} as size from (
    select doc_id, text as t, cast(n_chars as varchar) || case when lang = 'en' then '' else ' ' || lang end as n from documents)""")
def coerce_numeric(spark, sf):
    d = X.read(spark, sf, "documents")
    size = F.concat(F.col("n_chars").cast("string"), F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit(" "), "lang")))
    return d.select("doc_id", N.coerce_numeric("text").alias("value"), N.coerce_numeric(size).alias("size"))


@REG.add("build_timestamp", """select event_id, case when user_id <> 7 and user_id <> 9 then cast(cast(ts as date) as timestamp) + hour(ts) * interval 1 hour end as ts from events""")
def build_timestamp(spark, sf):
    e = X.events(spark, sf).select(
        "event_id", F.when(F.col("user_id") == 7, "unknown").otherwise(F.to_date("ts").cast("string")).alias("date"),
        F.when(F.col("user_id") == 9, "x").otherwise((F.hour("ts") + 1).cast("string")).alias("time"),
    )
    return e.select("event_id", N.build_timestamp("date", "time").alias("ts"))


@REG.add("parse_hour_label", "select event_id, cast(case when user_id = 7 then 24 else hour(ts) + 1 end as integer) as hour from events")
def parse_hour_label(spark, sf):
    h, k = F.hour("ts").cast("string"), F.col("user_id") % 3
    text = (
        F.when(F.col("user_id") == 7, "24").when(k == 0, F.concat(F.lpad(h, 2, "0"), F.lit(":00")))
        .when(k == 1, F.concat(h, F.lit(":00"))).otherwise(F.concat(F.lit(" "), h))
    )
    return X.events(spark, sf).select("event_id", N.parse_hour_label(text).alias("hour"))


@REG.add("flex_timestamp", """select event_id, case user_id % 4 when 0 then date_trunc('second', ts) when 1 then date_trunc('minute', ts)
    else date_trunc('hour', ts) end as ts from events""")
def flex_timestamp(spark, sf):
    e, k = X.events(spark, sf), F.col("user_id") % 4
    stamp = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("n/a")
    clock = F.date_format("ts", "HH:mm")
    hour = F.when(k == 1, clock).when(k == 2, (F.hour("ts") + 1).cast("string")).otherwise(F.concat(F.hour("ts").cast("string"), F.lit(":00:00")))
    return e.select("event_id", N.flex_timestamp(stamp, F.to_date("ts").cast("string"), hour).alias("ts"))


@REG.add("hour_label", "select event_id, case when hour(ts) = 0 then '00:00' else hour(ts) || ':00' end as label from events")
def hour_label(spark, sf):
    return X.events(spark, sf).select("event_id", N.hour_label(F.hour("ts") + 1).alias("label"))


# --- reshaping -------------------------------------------------------------

def wide_panel(spark, sf):
    """One row per hour with internal column names, one column per unit and site."""
    p = X.panel(spark, sf)
    units = [
        F.max(F.when((F.col("site") == s) & (F.col("unit") == u), F.col("mw"))).alias(f"gen_{s}_gen_{s}_{u}") for s in SITES for u in UNITS
    ]
    exact = lambda s: F.sum(F.when(F.col("site") == s, F.col("mw")).cast("decimal(18,2)")).cast("double")
    return p.groupBy("ts").agg(*units, *[exact(s).alias(f"total_gen_{s}") for s in SITES]).select(
        F.to_date("ts").alias("date"), (F.hour("ts") + 1).alias("time"), "*"
    )


@REG.add("project_public", "select cast(ts as date) as date, cast(hour(ts) + 1 as integer) as time, " + ", ".join(
    f"max(case when site = '{s}' and unit = '{u}' then mw end) as gen_{s}_{u}" for s in SITES for u in UNITS) + ", " + ", ".join(
    f"cast(sum(case when site = '{s}' then cast(mw as decimal(18,2)) end) as double) as total_gen_{s}" for s in SITES)
    + ", cast(sum(case when site = 'click' then cast(mw as decimal(18,2)) end) as double) as click_total from panel group by panel.ts")
def project_public(spark, sf):
    return N.with_aliases(N.project_public(wide_panel(spark, sf)), {"click_total": "total_gen_click"})


def forecast_wide(spark, sf, name=lambda s: f"total_gen_{s}", keys=("forecast_date", "model")):
    f = X.forecasts(spark, sf)
    return f.groupBy(*keys, F.to_date("ts").alias("Date"), F.col("forecast_hour").alias("Hour")).agg(
        *[F.max(F.when(F.col("site") == s, F.col("mw"))).alias(name(s)) for s in SITES]
    )


@REG.add("normalize_forecast", "select forecast_date, model, ts, cast(ts as date) as date, forecast_hour, " + ", ".join(
    f"max(case when site = '{s}' then mw end) as total_gen_{s}" for s in SITES) + f", {r6s('sum(mw)')} as total_cascade_generation from forecasts group by forecast_date, model, ts, forecast_hour")
def normalize_forecast(spark, sf):
    styles = {"click": "Total_Gen_Click_MW", "view": "Total_Generation_View(MW)", "signup": "total-signup", "purchase": "TOTAL GEN PURCHASE MW", "error": "total_gen_error"}
    raw = forecast_wide(spark, sf, lambda s: styles[s])
    return rounded(N.normalize_forecast(raw, SITES, ["forecast_date", "model"]), skip=("forecast_date", "model", "ts", "date", *TOTALS))


@REG.add("normalize_predictions", """select case model when 'persistence' then 'RBFNN' when 'naive24' then 'Random Forest' else 'XGBoost' end as model,
    site, ts, actual, predicted from predictions where predicted > 0""")
def normalize_predictions(spark, sf):
    p = X.stored_predictions(spark, sf)
    spelled = F.when(F.col("model") == "persistence", "rbf").when(F.col("model") == "naive24", "Random-Forest").otherwise(" XGB ")
    raw = p.select(
        spelled.alias("Model"), F.upper("site").alias("Plant"), F.to_date("ts").cast("string").alias("Date"),
        F.col("forecast_hour").alias("Hour"), F.col("actual").cast("string").alias("Actual MW"),
        F.when(F.col("predicted") > 0, F.col("predicted").cast("string")).otherwise("none").alias("Prediction"),
    )
    return N.normalize_predictions(raw.unionAll(raw), "RBFNN", SITES)


@REG.add("align_features", """select site, ts, coalesce(lag(total, 24) over w, 0.0) as lag24, cast(0 as double) as rain_lag1,
    total as current, coalesce(lag(total, 1) over w, 0.0) as lag1 from site_series window w as (partition by site order by ts)""")
def align_features(spark, sf):
    s = X.site_series(spark, sf)
    f = s.select("site", "ts", F.col("total").alias("current"), *E.lags("total", series_window(["site"]), [1, 6, 24]))
    return N.align_features(f, ["lag24", "rain_lag1", "current", "lag1"], ["site", "ts"])[0]


@REG.add("melt_totals", "select forecast_date, model, forecast_hour, site, mw from forecasts")
def melt_totals(spark, sf):
    wide = forecast_wide(spark, sf).withColumnRenamed("Hour", "forecast_hour")
    return N.melt_totals(wide, SITES, ["forecast_date", "model", "forecast_hour"])


MODELS = ["persistence", "naive24", "naive168"]


def test_metrics(spark, sf, split="testing", p=None):
    p = (X.predictions(spark, sf) if p is None else p).where(F.col("split") == split)
    return rounded(p.groupBy("model", "site").agg(*metric_columns()))


METRICS = {
    "tm": f"""select split, model, site, {r6s('operational_mape')} as operational_mape, {r6s('mae')} as mae, {r6s('rmse')} as rmse, {r6s('r2')} as r2
        from (select split, model, site, {metric_sql()} from predictions group by split, model, site)"""
}


@REG.add("pivot_models", "select site, " + ", ".join(f"max(case when model = '{m}' then mae end) as {m}" for m in MODELS)
         + " from tm where split = 'testing' group by site", METRICS)
def pivot_models(spark, sf):
    return N.pivot_models(test_metrics(spark, sf), MODELS, "mae")


@REG.add("ordered_category", """select t.model, t.site, d.ordinal, t.mae
    from tm t join site_dim d on d.site = t.site where t.split = 'testing'""", METRICS)
def ordered_category(spark, sf):
    t = N.ordered_category(test_metrics(spark, sf).select("model", "site", "mae"), X.site_dim(spark, sf))
    return t.orderBy("ordinal", "model")


def wide_metrics(spark, sf):
    p = X.stored_predictions(spark, sf)
    v, t = test_metrics(spark, sf, "validation", p), test_metrics(spark, sf, "testing", p)
    names = ["operational_mape", "mae", "rmse", "r2"]
    v = v.select("model", "site", *[F.col(n).alias(f"val_{n}") for n in names])
    return v.join(t.select("model", "site", *[F.col(n).alias(f"test_{n}") for n in names]), ["model", "site"]).withColumn("feature_count", F.lit(1))


@REG.add("metric_frame_split", "select model, site, 1 as feature_count, split, operational_mape, mae, rmse, r2 from tm where split <> 'train'", METRICS)
def metric_frame_split(spark, sf):
    return N.metric_frame_split(wide_metrics(spark, sf))


# --- sources and sinks -----------------------------------------------------

@REG.add("load_readings", "select event_id, ts, event_type, value from events")
def load_readings(spark, sf):
    e = tables.load_readings(X.tune(spark), f"{sf}/readings.parquet", f"{sf}/events*.parquet")
    return e.select("event_id", "ts", "event_type", "value")


@REG.add("write_panel", "select site, unit, strftime(ts, '%Y-%m-%d') as date, cast(hour(ts) + 1 as integer) as time, mw, available from panel")
def write_panel(spark, sf):
    path = tables.scratch(spark, "panel")
    tables.write_panel(X.panel(spark, sf), path)
    return spark.read.parquet(path).select("site", "unit", "date", "time", "mw", "available")


@REG.add("load_panel", "select site, unit, ts, mw from panel")
def load_panel(spark, sf):
    folder = tables.scratch(X.tune(spark), "cleaned")
    tables.write_panel(X.panel(spark, sf), f"{folder}/panel.parquet")
    return tables.load_panel(spark, folder).select("site", "unit", "ts", "mw")


@REG.add("write_forecast", "select model, strftime(ts, '%Y-%m-%d') as Date, case when hour(ts) = 0 then '00:00' else hour(ts) || ':00' end as Hour, "
         + ", ".join(f"max(case when site = '{s}' then mw end) as Total_Gen_{s.capitalize()}_MW" for s in SITES)
         + f", {r6s('sum(mw)')} as Total_Cascade_Generation_MW from forecasts group by model, ts")
def write_forecast(spark, sf):
    path = tables.scratch(spark, "forecast")
    f = N.normalize_forecast(forecast_wide(spark, sf), SITES, ["forecast_date", "model"]).drop("date", "forecast_date")
    tables.write_forecast(f, path, ["model"])
    back = spark.read.csv(path, header=True)
    return rounded(back.select("model", "Date", "Hour", *[F.col(c).cast("double").alias(c) for c in back.columns if c not in ("model", "Date", "Hour")]))


PLAN = [(s, u) for s in SITES for u in UNITS]
PLAN_TEXT = "case when x is null then null when x > 20 then '1' when x > 10 then 'n/a' when x > 5 then '0' else '-1' end"


@REG.add("load_outage_plan", f"""select p.site, p.unit, p.ts, case when coalesce({sql_number(PLAN_TEXT)}, 1.0) > 0 then 1 else 0 end as available
    from (select site, unit, ts, mw as x from panel) p""")
def load_outage_plan(spark, sf):
    x = X.panel(spark, sf).groupBy("ts").agg(
        *[F.max(F.when((F.col("site") == s) & (F.col("unit") == u), F.col("mw"))).alias(f"out_{s}_{u}") for s, u in PLAN]
    )
    text = lambda c: F.when(F.col(c) > 20, "1").when(F.col(c) > 10, "n/a").when(F.col(c) > 5, "0").when(F.col(c).isNotNull(), "-1")
    raw = x.select(
        F.to_date("ts").alias(" DATE "), F.concat(F.hour("ts").cast("string"), F.lit(":00")).alias("Hour "),
        *[text(f"out_{s}_{u}").alias(f"out_{s}_{u}") for s, u in PLAN],
    )
    return tables.load_outage_plan(raw)


@REG.add("save_outage_plan", """select event_id, cast(case when user_id = 7 then 1 else round_even(greatest(0.0, least(1.0, value / 40 - 0.2)), 0) end as integer) as status from events""")
def save_outage_plan(spark, sf):
    path = tables.scratch(spark, "plan")
    e = X.events(spark, sf).select(
        "event_id", F.when(F.col("user_id") == 7, "?").otherwise((F.col("value") / 40 - 0.2).cast("string")).alias("status")
    )
    tables.save_outage_plan(e, path, ["status"])
    return spark.read.parquet(path)


@REG.add("load_actuals", """select site, d, hour, value, event_id from (select event_type as site, cast(ts as date) as d,
    cast(user_id % 30 as integer) as hour, case when user_id % 11 = 0 then null else value end as value, event_id,
    row_number() over (partition by event_type, cast(ts as date) order by event_id) as i from events
    where user_id % 30 between 1 and 24) where i <= 24""")
def load_actuals(spark, sf):
    e = X.events(spark, sf).select(
        F.col("event_type").alias("site"), F.to_date("ts").alias("d"), (F.col("user_id") % 30).cast("string").alias("TIME"),
        F.when(F.col("user_id") % 11 == 0, "-").otherwise(F.col("value").cast("string")).alias("value"), "event_id",
    )
    return tables.load_actuals(e, ["site", "d"], "TIME", ["value"], "event_id")


@REG.add("load_predictions_union", """select *, (select count(distinct (first_ts, last_ts)) from spans) = 1 as ranges_identical from spans""",
         {"spans": """select model, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from predictions
            where model <> 'naive168' or split = 'testing' group by model"""})
def load_predictions_union(spark, sf):
    p = X.stored_predictions(spark, sf)
    frames = {m: p.where(F.col("model") == m) for m in MODELS}
    frames["naive168"] = frames["naive168"].where("split = 'testing'")
    frames["broken"] = p.select("site", "ts")
    return store.predictions_union(frames)[1]


KEEP = "model <> 'naive168' and site in ('view', 'error')"


@REG.add("upsert_audit", f"""select model, site, split, mae from tm where split = 'testing' and {KEEP}
    union all select model, site, split, mae from tm where split = 'validation' and not ({KEEP})""", METRICS)
def upsert_audit(spark, sf):
    p = X.stored_predictions(spark, sf)
    shape = lambda split: test_metrics(spark, sf, split, p).select("model", "site", F.lit(split).alias("split"), "mae")
    return store.upsert(shape("validation"), shape("testing").where(KEEP), ["model", "site"])


@REG.add("replace_partition_rows", """select t.site, t.model, t.split, t.mae, d.ordinal from tm t join site_dim d on d.site = t.site
    where (t.split = 'testing' and t.site in ('view', 'error')) or (t.split = 'validation' and t.site not in ('view', 'error'))""", METRICS)
def replace_partition_rows(spark, sf):
    p = X.stored_predictions(spark, sf)
    shape = lambda split: test_metrics(spark, sf, split, p).select("site", "model", F.lit(split).alias("split"), "mae")
    fresh = shape("testing").where("site in ('view', 'error')")
    return store.replace_partition_rows(shape("validation"), fresh, X.site_dim(spark, sf))


@REG.add("run_metadata", """select min(ts) as data_start, max(ts) as data_end,
    (select count(distinct d) from btd where split = 'validation') as validation_days,
    (select count(distinct d) from btd where split = 'testing') as testing_days,
    'RBFNN,naive168,naive24,persistence' as models, """ + ", ".join(f"'{v}' as {k}" for k, v in store.POLICIES.items()) + " from panel", BACKTEST)
def run_metadata(spark, sf):
    p = X.stored_panel(spark, sf)
    v, t = X.cuts(spark, sf, p)
    days = P.backtest_days(X.site_series(spark, sf, p).withColumn("split", P.cut_split("ts", v, t)))
    return store.run_metadata(p, days, X.predictions(spark, sf, p), ["RBFNN", "naive24"])


@REG.add("cleaning_metadata", """select max(ts) as latest_timestamp, count(*) as rows, 'site,unit,ts,mw,available' as columns,
    (select count(*) from (select cast(ts as date) from level group by 1 having count(distinct level) > 1)) as dates_with_multiple_values,
    (select count(*) from (select cast(ts as date) from level group by 1 having count(distinct level) > 1)) = 0 as consistency_passed from panel""")
def cleaning_metadata(spark, sf):
    from ..operators.cleaning import daily_consistency

    p = X.panel(spark, sf)
    return store.cleaning_metadata(p, daily_consistency(X.level(spark, sf), "level"), p.columns)
