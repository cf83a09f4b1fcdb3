"""Registered queries: metrics, comparisons, summaries and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as L
from ..operators import calibration as H
from ..operators import metrics as K
from ..operators import outage as I
from ..operators import slices as C
from . import fixtures as X
from . import q_calibration as QC
from . import q_outage as QO
from .fixtures import metric_sql, r6s, rows_sql
from .q_features import rounded
from .registry import Registry

REG = Registry()
M4 = ["operational_mape", "mae", "rmse", "r2"]
MODELS = ["persistence", "naive24", "naive168"]
GROUPED = {"gm": f"select model, site, split, count(*) as n, {metric_sql()} from predictions group by model, site, split"}


@REG.add("forecast_metrics", rows_sql("select * from gm", M4), GROUPED)
def forecast_metrics(spark, sf):
    return rounded(K.forecast_metrics(X.predictions(spark, sf)))


@REG.add("mape_coverage", f"""select model, site, count(distinct forecast_date) as forecast_days, count(*) as forecast_hours,
    count(*) filter (abs(actual) >= t) as rows_included, count(*) filter (abs(actual) < t) as rows_excluded,
    {r6s('count(*) filter (abs(actual) < t) / count(*)')} as excluded_fraction,
    count(*) filter (abs(actual) < t) / count(*) > 0.4 as low_load_regime
    from (select *, greatest(1.0, 0.01 * capacity) as t from predictions) group by model, site""")
def mape_coverage(spark, sf):
    return rounded(K.mape_coverage(X.predictions(spark, sf)))


@REG.add("daily_metrics", rows_sql(f"select model, site, forecast_date, {metric_sql()}, count(*) as samples from predictions group by all", M4[:3]).replace("select * replace", "select * exclude (r2) replace"))
def daily_metrics(spark, sf):
    return rounded(K.daily_metrics(X.predictions(spark, sf)))


def shape_sql(src: str, keys: str, order: str) -> str:
    return f"""select {keys}, round(avg(ape) + 1e-9, 2) as shape_mape, count(*) filter (ape <= 3) as ape_le_3_count, round(max(ape) + 1e-9, 2) as max_ape,
        {r6s('avg(case when da is null then null when sign(da) = sign(dp) then 1.0 else 0.0 end)')} as trend_match_rate, {r6s('avg(abs(da - dp))')} as delta_mae
        from (select {keys}, abs(actual - predicted) / greatest(abs(actual), 1e-6) * 100 as ape, actual - lag(actual) over w as da,
          predicted - lag(predicted) over w as dp from {src} window w as (partition by {keys} order by {order})) group by {keys}"""


def shaped(df):
    """Percentages of near-zero readings are huge: two decimals are enough."""
    two = {c: F.round(F.col(c) + 1e-9, 2) for c in ("shape_mape", "max_ape")}
    return rounded(df.withColumns(two), skip=("shape_mape", "max_ape"))


@REG.add("shape_metrics", shape_sql("predictions", "model, site, split", "ts"))
def shape_metrics(spark, sf):
    return shaped(K.shape_metrics(X.predictions(spark, sf)))


@REG.add("plain_mape", f"select model, site, {r6s('100 * avg(case when actual <> 0 then abs((actual - predicted) / actual) end)')} as mape from predictions group by all")
def plain_mape(spark, sf):
    return rounded(K.plain_mape(X.predictions(spark, sf)))


DIAG = {"dd": """select forecast_date, model, site, forecast_hour as hour, actual, mw as predicted, abs(actual - mw) as absolute_error,
    abs(actual - mw) / greatest(abs(actual), 1e-6) * 100 as ape from forecasts"""}


def diagnostics(spark, sf):
    f = X.forecasts(spark, sf)
    forecast = f.select("forecast_date", "model", "site", F.col("forecast_hour").alias("hour"), F.col("mw").alias("predicted"))
    actual = X.site_series(spark, sf).select(F.to_date("ts").alias("forecast_date"), "site", (F.hour("ts") + 1).alias("hour"), F.col("total").alias("actual"))
    return K.day_diagnostics(actual, forecast, ("forecast_date", "site", "hour"))


@REG.add("day_diagnostics", rows_sql("select * from dd", ["absolute_error", "ape"]), DIAG)
def day_diagnostics(spark, sf):
    return rounded(diagnostics(spark, sf))


@REG.add("day_diagnostics_summary", f"""select s.*, m.mae, m.rmse from ({shape_sql('dd', 'forecast_date, model, site', 'hour')}) s
    join (select forecast_date, model, site, {r6s('avg(absolute_error)')} as mae, {r6s('sqrt(avg(absolute_error * absolute_error))')} as rmse from dd group by all) m
    on m.forecast_date = s.forecast_date and m.model = s.model and m.site = s.site""", DIAG)
def day_diagnostics_summary(spark, sf):
    return shaped(K.day_diagnostics_summary(diagnostics(spark, sf), ("forecast_date", "model", "site")))


# --- comparing models ------------------------------------------------------

def metrics(spark, sf, split=None):
    p = X.stored_predictions(spark, sf)
    return K.forecast_metrics(p if split is None else p.where(F.col("split") == split))


def feature_counts(spark, sf):
    """Feature count per site: one per distinct user seen there (stand-in for a model store)."""
    e = X.events(spark, sf)
    return e.groupBy(F.col("event_type").alias("site")).agg(F.count_distinct("user_id").cast("int").alias("feature_count"))


SIDES = ", ".join(f"{r6s(f'v.{n}')} as val_{n}, {r6s(f't.{n}')} as test_{n}" for n in M4)
FC = {"fc": "select event_type as site, cast(count(distinct user_id) as integer) as feature_count from events group by 1"}


@REG.add("val_test_summary", f"""select v.model, v.site, {SIDES}, coalesce(f.feature_count, 0) as feature_count from gm v
    join gm t on t.model = v.model and t.site = v.site and t.split = 'testing' left join fc f on f.site = v.site where v.split = 'validation'""", GROUPED | FC)
def val_test_summary(spark, sf):
    return rounded(K.val_test_summary(metrics(spark, sf), feature_counts(spark, sf)))


@REG.add("model_leaderboard", rows_sql("""select gm.*, cast(row_number() over (partition by gm.site order by operational_mape, model) as integer) as rank,
    d.ordinal from gm join site_dim d on d.site = gm.site where split = 'testing'""", M4), GROUPED)
def model_leaderboard(spark, sf):
    return rounded(K.model_leaderboard(metrics(spark, sf, "testing"), X.site_dim(spark, sf)))


@REG.add("best_model", "select site, model as best_model, " + ", ".join(f"{r6s(n)} as testing_{n}" for n in M4)
         + " from gm where split = 'testing' qualify row_number() over (partition by site order by operational_mape, model) = 1", GROUPED)
def best_model(spark, sf):
    return rounded(K.best_model(metrics(spark, sf, "testing")))


@REG.add("head_to_head", "select a.site, b.model as rival, " + ", ".join(
    f"{r6s(f'a.{n}')} as primary_{n}, {r6s(f'b.{n}')} as rival_{n}, a.{n} {'>' if n == 'r2' else '<'} b.{n} as won_{n}" for n in M4)
    + " from gm a join gm b on b.site = a.site and b.split = a.split and b.model <> a.model where a.split = 'testing' and a.model = 'naive24'", GROUPED)
def head_to_head(spark, sf):
    return rounded(K.head_to_head(metrics(spark, sf, "testing"), "naive24"))


# --- error distributions ---------------------------------------------------

@REG.add("residuals", f"""select model, bin, count(*) as n, {r6s('min(lo) + bin * (min(hi) - min(lo)) / 60')} as bin_from, {r6s('min(lo) + (bin + 1) * (min(hi) - min(lo)) / 60')} as bin_to
    from (select model, cast(least(floor((r - lo) * 60 / (hi - lo)), 59) as integer) as bin, lo, hi from (
      select model, actual - predicted as r, min(actual - predicted) over w as lo, max(actual - predicted) over w as hi
      from predictions window w as (partition by model))) group by model, bin""")
def residuals(spark, sf):
    return rounded(K.residual_histogram(X.stored_predictions(spark, sf)))


@REG.add("scatter_extent", "select model, min(least(actual, predicted)) as low, max(greatest(actual, predicted)) as high from predictions group by model")
def scatter_extent(spark, sf):
    return K.scatter_extent(X.predictions(spark, sf))


ERR = {
    "ea": "select model, abs(actual - predicted) as e from predictions",
    "ep": "select model, abs(actual - predicted) / abs(actual) * 100 as e from predictions where abs(actual) >= greatest(1.0, 0.01 * capacity) and abs(actual) > 0",
}
CDF = """select model, {e} as error_value, {p} as cdf_probability, n as observations from (
    select model, e, row_number() over (partition by model order by e) as i, count(*) over (partition by model) as n from {src})"""
QUANT = "select model, count(*) as n, " + r6s("100 * avg(case when e <= 5 then 1.0 else 0.0 end)") + " as within_5, " + r6s(
    "100 * avg(case when e <= 10 then 1.0 else 0.0 end)") + " as within_10, " + ", ".join(
    f"{r6s(f'quantile_cont(e, {q})')} as {n}" for n, q in (("median", 0.5), ("p80", 0.8), ("p90", 0.9), ("p95", 0.95))) + " from {src} group by model"

for _name, _src, _pct in (("", "ea", False), ("_percentage", "ep", True)):
    REG.add(f"error_cdf{_name}", CDF.format(e=r6s("e"), p=r6s("cast(i as double) / n"), src=_src), ERR)(
        lambda spark, sf, pct=_pct: rounded(K.error_cdf(K.error_values(X.stored_predictions(spark, sf), pct)))
    )
    REG.add(f"error_quantiles{_name}", QUANT.format(src=_src), ERR)(
        lambda spark, sf, pct=_pct: rounded(K.error_quantiles(K.error_values(X.stored_predictions(spark, sf), pct)))
    )


# --- forecast summaries ----------------------------------------------------

SUMS = {
    "cs": "select forecast_date, model, forecast_hour, sum(mw) as mw from forecasts group by all",
}
DAY = ("forecast_date", "model")


def five(keys: str, src: str) -> str:
    return f"""select {keys}, {r6s('min(mw)')} as minimum, {r6s('max(mw)')} as maximum, {r6s('avg(mw)')} as average,
        (list(forecast_hour order by mw desc, forecast_hour))[1] as peak_hour, {r6s('sum(mw)')} as energy from {src} group by {keys}"""


@REG.add("forecast_kpis", f"""select cs.forecast_date, model, {r6s('sum(mw)')} as cascade_energy, {r6s('max(mw)')} as peak, coalesce(any_value(p.sites), 'None') as affected
    from cs left join (select cast(origin as date) as d, string_agg(distinct site, ',' order by site) as sites from plan_last where available <= 0 group by 1) p on p.d = cs.forecast_date
    group by cs.forecast_date, model""", SUMS | QO.OUT)
def forecast_kpis(spark, sf):
    plan = QO.last_plan(spark, sf).withColumn("forecast_date", F.to_date("origin"))
    return rounded(K.forecast_kpis(X.forecasts(spark, sf), I.outage_summary(plan, ("forecast_date",))))


@REG.add("series_summary", five("forecast_date, model", "cs"), SUMS)
def series_summary(spark, sf):
    return rounded(K.series_summary(K.cascade_series(X.forecasts(spark, sf), DAY), DAY))


@REG.add("all_sites_summary", five("forecast_date, model, site", "forecasts"), SUMS)
def all_sites_summary(spark, sf):
    return rounded(K.series_summary(X.forecasts(spark, sf), (*DAY, "site")))


@REG.add("cascade_comparison", f"""select forecast_date, model, {r6s('avg(mw)')} as mean, {r6s('min(mw)')} as minimum, {r6s('max(mw)')} as maximum,
    (list(forecast_hour order by mw desc, forecast_hour))[1] as peak_hour, (list(forecast_hour order by mw, forecast_hour))[1] as lowest_hour
    from cs group by forecast_date, model""", SUMS)
def cascade_comparison(spark, sf):
    return rounded(K.cascade_comparison(X.forecasts(spark, sf), DAY))


@REG.add("pairwise_difference", f"""select a.forecast_date, a.model || ' vs ' || b.model as model_pair, {r6s('avg(abs(a.mw - b.mw))')} as mean_abs_difference
    from cs a join cs b on b.forecast_date = a.forecast_date and b.forecast_hour = a.forecast_hour and (a.model, b.model) in (('persistence', 'naive24'), ('persistence', 'naive168'), ('naive24', 'naive168'))
    group by a.forecast_date, a.model, b.model""", SUMS)
def pairwise_difference(spark, sf):
    return rounded(K.pairwise_difference(K.cascade_series(X.forecasts(spark, sf), DAY), MODELS, ("forecast_date",)))


@REG.add("model_spread", f"select forecast_date, forecast_hour, {r6s('min(mw)')} as lowest, {r6s('max(mw)')} as highest from cs group by forecast_date, forecast_hour", SUMS)
def model_spread(spark, sf):
    return rounded(K.model_spread(K.cascade_series(X.forecasts(spark, sf), DAY), ("forecast_date",)))


@REG.add("latest_timestamp", "select greatest(max(o_orderdate), max(try_cast(o_orderpriority as timestamp))) as latest from orders")
def latest_timestamp(spark, sf):
    o = X.read(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("string").alias("order_date"), F.col("o_orderpriority").alias("time_class")
    )
    return K.latest_timestamp(o)


# --- audits ----------------------------------------------------------------

FEATS = {
    "feats": """select distinct event_type as site, 'total_' || event_type || case user_id % 7 when 0 then case when event_type = 'view' then '_lag0' else '_tplus1' end
        when 1 then case when event_type in ('view', 'click') then '_lag1' else '_Forecast' end else '_lag' || user_id end as feature from events""",
    "bad": "select *, regexp_matches(feature, '(?i)_tplus1$|_delta_tplus1$|actual|predicted|forecast|testing|validation') as bad from feats",
    "audit": """select site, count(distinct feature) as feature_count, coalesce(string_agg(distinct case when bad then feature end, ',' order by case when bad then feature end), '') as forbidden,
        case when bool_or(bad) then 'FAIL' else 'PASS' end as leakage_check, (select case when bool_or(bad) then 'FAIL' else 'PASS' end from bad) as overall
        from bad group by site""",
}


def feature_names(spark, sf):
    k, s = F.col("user_id") % 7, F.col("event_type")
    tail = (
        F.when(k == 0, F.when(s == "view", "_lag0").otherwise("_tplus1"))
        .when(k == 1, F.when(s.isin("view", "click"), "_lag1").otherwise("_Forecast"))
        .otherwise(F.concat(F.lit("_lag"), F.col("user_id").cast("string")))
    )
    return X.events(spark, sf).select(s.alias("site"), F.concat(F.lit("total_"), s, tail).alias("feature")).distinct()


@REG.add("leakage_audit", "select * from audit", FEATS)
def leakage_audit(spark, sf):
    return L.leakage_audit(feature_names(spark, sf))


@REG.add("leakage_data_check", """select site, max(ts_known) as latest_feature_ts, count(*) filter (ts_known >= origin) as violations, count(*) as rows
    from (select u.site, u.unit, o.origin, max(u.ts) as ts_known from u join origins o on u.ts < o.origin group by all) group by site""")
def leakage_data_check(spark, sf):
    known = C.last_known(X.unit_readings(spark, sf), ["site", "unit"], "mw", X.origins(spark, sf))
    return L.leakage_data_check(known)


@REG.add("fairness_audit", """select p.model, p.site, a.feature_count, 'chronological 70/15/15' as split_strategy, 'training set only' as scaler_fitting,
    'validation set only' as calibration_selection, 'final evaluation only' as testing_use, a.leakage_check
    from (select distinct model, site from predictions) p join audit a on a.site = p.site""", FEATS)
def fairness_audit(spark, sf):
    return L.fairness_audit(X.predictions(spark, sf), L.leakage_audit(feature_names(spark, sf)))


REPORT = f"""select s.site, s.shrinkage, {r6s('s.bias')} as bias, b.scale is not null as bins_used, h.scale is not null as hourly_used,
    p.w is not null as blend_used, {r6s('r.ramp')} as ramp"""
REPORT_FROM = """ from sfit s join bfit b on b.site = s.site join hfit h on h.site = s.site join pfit p on p.site = s.site join ramps r on r.site = s.site"""


def report(spark, sf):
    p = X.stored_panel(spark, sf)
    rows = QC.calibration_rows(spark, sf, p=p)
    half = QC.half_step(rows)
    return L.calibration_report(
        H.fit_shrinkage_bias(rows), H.fit_bin_calibration(half), H.fit_hourly_correction(half), H.fit_profile_blend(half), QC.train_ramps(spark, sf, p)
    )


@REG.add("calibration_report", f"{REPORT}, 'validation' as derived_from, false as testing_used{REPORT_FROM}", QC.CAL)
def calibration_report(spark, sf):
    return rounded(report(spark, sf))


@REG.add("selection_audit", f"""select x.*, y.* exclude (site) from (select v.model, v.site, {SIDES}, coalesce(f.feature_count, 0) as feature_count from gm v
    join gm t on t.model = v.model and t.site = v.site and t.split = 'testing' left join fc f on f.site = v.site where v.split = 'validation') x
    join ({REPORT}{REPORT_FROM}) y on y.site = x.site""", QC.CAL | GROUPED | FC)
def selection_audit(spark, sf):
    summary = K.val_test_summary(metrics(spark, sf), feature_counts(spark, sf))
    return rounded(L.selection_audit(summary, report(spark, sf)))


@REG.add("feature_drift_warning", """select e.site, 'rain_lag' || n as feature from (select distinct site, unnest([1, 3, 6, 12, 24]) as n from level where level is not null) e
    where not exists (select 1 from events v where v.event_type = e.site and v.user_id % 25 = e.n and v.value > 250)""")
def feature_drift_warning(spark, sf):
    e = X.events(spark, sf)
    saved = e.where("value > 250").select(
        F.col("event_type").alias("site"), F.concat(F.lit("rain_lag"), (F.col("user_id") % 25).cast("string")).alias("feature")
    )
    return L.feature_drift_warning(saved, X.level(spark, sf).withColumnRenamed("level", "rain"))
