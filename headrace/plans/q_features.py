"""Registered queries: slices, features, splits and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import metric_columns, r6, series_window
from ..operators import baselines as G
from ..operators import cleaning as D
from ..operators import features as E
from ..operators import models as M
from ..operators import slices as C
from ..operators import splits as P
from ..session import cut_lineage
from . import fixtures as X
from .fixtures import metric_sql, r6s, rows_sql
from .registry import Registry

REG = Registry()
W = "window w as (partition by site order by ts)"


def rounded(df, skip=("site", "unit", "ts", "origin", "model", "d", "split")):
    kinds = dict(df.dtypes)
    return df.select(*[r6(c).alias(c) if kinds[c] == "double" and c not in skip else F.col(c) for c in df.columns])


# --- slices ----------------------------------------------------------------

@REG.add("history_before", """select s.site, s.ts, s.total, min(o.origin) as known_from from site_series s
    join origins o on s.ts < o.origin group by s.site, s.ts, s.total""")
def history_before(spark, sf):
    """The histories of all origins: rows with ``known_from`` up to the origin."""
    return C.known_from(X.site_series(spark, sf), X.origins(spark, sf)).select("site", "ts", "total", "known_from")


@REG.add("history_by_origin", """select s.site, o.origin, count(*) as n, min(s.ts) as first_ts, max(s.ts) as last_ts, arg_max(s.total, s.ts) as newest,
    cast(sum(cast(s.total as decimal(18,6))) as double) as total from site_series s join origins o on s.ts < o.origin group by s.site, o.origin""")
def history_by_origin(spark, sf):
    return C.history_by_origin(X.site_series(spark, sf), ["site"], "total", X.origins(spark, sf))


@REG.add("actual_day", "select s.site, o.origin, s.ts, s.total from site_series s join origins o on cast(s.ts as date) = cast(o.origin as date)")
def actual_day(spark, sf):
    return C.actual_day(X.site_series(spark, sf), X.origins(spark, sf)).select("site", "origin", "ts", "total")


@REG.add("bounded_history", f"""select s.site, o.origin, count(*) as n, arg_min(s.total, s.ts) as oldest,
    arg_max(s.total, s.ts) as newest, {r6s('avg(s.total)')} as mean
    from site_series s join origins o on s.ts < o.origin and s.ts >= o.origin - interval 240 hour group by s.site, o.origin""")
def bounded_history(spark, sf):
    h = C.bounded_history(X.site_series(spark, sf), ["site"], "total")
    total = F.aggregate("history", F.lit(0.0), lambda a, v: a + v)
    return h.select(
        "site", "origin", F.size("history").cast("bigint").alias("n"), F.col("history")[0].alias("oldest"),
        F.element_at("history", -1).alias("newest"), r6(total / F.size("history")).alias("mean"),
    )


@REG.add("last_known", """select u.site, u.unit, o.origin, max(u.ts) as ts_known, arg_max(u.mw, u.ts) as mw
    from u join origins o on u.ts < o.origin group by u.site, u.unit, o.origin""")
def last_known(spark, sf):
    known = C.last_known(X.unit_readings(spark, sf), ["site", "unit"], "mw", X.origins(spark, sf))
    return C.assert_before_origin(known, "ts_known").select("site", "unit", "origin", "ts_known", "mw")


@REG.add("value_at_lag", f"select site, ts, coalesce(lag(total, 24) over w, 0.0) as v24, coalesce(lag(total, 168) over w, 0.0) as v168 from site_series {W}")
def value_at_lag(spark, sf):
    w = series_window(["site"])
    return X.site_series(spark, sf).select(
        "site", "ts", C.value_at_lag("total", 24, w).alias("v24"), C.value_at_lag("total", 168, w).alias("v168")
    )


@REG.add("operational_filter", "select model, site, ts, actual from predictions where abs(actual) >= greatest(1.0, 0.01 * capacity)")
def operational_filter(spark, sf):
    return C.operational_filter(X.predictions(spark, sf)).select("model", "site", "ts", "actual")


@REG.add("filter_predictions", "select model, site, ts, actual, predicted from predictions where site = 'view' and model = 'naive24'")
def filter_predictions(spark, sf):
    p = C.filter_predictions(X.predictions(spark, sf), site="view", model="naive24")
    return p.select("model", "site", "ts", "actual", "predicted")


@REG.add("complete_cases", f"""select site, ts, total, lag168, delta_tplus1 from (select site, ts, total, lag(total, 168) over w as lag168,
    lead(total) over w - total as delta_tplus1 from site_series {W}) where lag168 is not null and delta_tplus1 is not null""".replace(
    "delta_tplus1 from (", f"{r6s('delta_tplus1')} as delta_tplus1 from (", 1))
def complete_cases(spark, sf):
    w = series_window(["site"])
    s = X.site_series(spark, sf)
    f = s.select("site", "ts", "total", *E.lags("total", w, [168]), *E.lead_target("total", w)).drop("current", "tplus1")
    return rounded(C.complete_cases(f, ["lag168", "delta_tplus1"]))


# --- features --------------------------------------------------------------

def sql_wave(x: str, period: int, prefix: str) -> str:
    a = f"2 * pi() * {x} / {period}.0"
    return f"{r6s(f'sin({a})')} as {prefix}_sin, {r6s(f'cos({a})')} as {prefix}_cos"


def sql_calendar(ts: str, prefix: str = "", month: bool = True) -> str:
    day = f"(isodow({ts}) - 1)"
    out = [sql_wave(f"hour({ts})", 24, f"{prefix}hour"), sql_wave(day, 7, f"{prefix}day")]
    if month:
        out.append(sql_wave(f"month({ts})", 12, f"{prefix}month"))
    return ", ".join(out) + f", case when {day} >= 5 then 1 else 0 end as {prefix}is_weekend"


def sql_lags(value: str, offsets=S.LAGS, prefix: str = "lag", over: str = "w") -> str:
    return ", ".join(f"lag({value}, {n}) over {over} as {prefix}{n}" for n in offsets)


def sql_rolling(value: str = "total", windows=S.ROLL_WINDOWS) -> str:
    out = []
    for n in windows:
        f = f"(partition by site order by ts rows between {n - 1} preceding and current row)"
        ok = f"count({value}) over {f} >= {max(2, n // 2)}"
        out += [
            f"{r6s(f'case when {ok} then avg({value}) over {f} end')} as rollmean{n}",
            f"{r6s(f'coalesce(case when {ok} then stddev_samp({value}) over {f} end, 0.0)')} as rollstd{n}",
            f"case when {ok} then min({value}) over {f} end as rollmin{n}",
            f"case when {ok} then max({value}) over {f} end as rollmax{n}",
        ]
    return ", ".join(out)


@REG.add("calendar_features", f"select site, ts, {sql_calendar('ts')} from site_series")
def calendar_features(spark, sf):
    return rounded(X.site_series(spark, sf).select("site", "ts", *E.calendar_features()))


@REG.add("target_calendar", f"select site, ts, {sql_calendar('ts + interval 1 hour', 'target_', False)} from site_series")
def target_calendar(spark, sf):
    return rounded(X.site_series(spark, sf).select("site", "ts", *E.target_calendar()))


@REG.add("lead_target", f"""select site, ts, total as current, lead(total) over w as tplus1,
    {r6s('lead(total) over w - total')} as delta_tplus1 from site_series {W}""")
def lead_target(spark, sf):
    return rounded(X.site_series(spark, sf).select("site", "ts", *E.lead_target("total", series_window(["site"]))))


@REG.add("lags", f"select site, ts, {sql_lags('total')} from site_series {W}")
def lags(spark, sf):
    return X.site_series(spark, sf).select("site", "ts", *E.lags("total", series_window(["site"])))


@REG.add("rolling_stats", f"select site, ts, {sql_rolling()} from site_series")
def rolling_stats(spark, sf):
    s = X.site_series(spark, sf).select("site", "ts", "total")
    return rounded(E.rolling_stats(s, ["site"], "total").drop("total"))


@REG.add("diffs", "select site, ts, " + ", ".join(f"{r6s(f'total - lag(total, {n}) over w')} as diff{n}" for n in S.DIFFS) + f" from site_series {W}")
def diffs(spark, sf):
    return rounded(X.site_series(spark, sf).select("site", "ts", *E.diffs("total", series_window(["site"]))))


@REG.add("target_lags", f"select site, ts, lag(total, 23) over w as target_lag24, lag(total, 167) over w as target_lag168 from site_series {W}")
def target_lags(spark, sf):
    return X.site_series(spark, sf).select("site", "ts", *E.target_lags("total", series_window(["site"])))


def filled_panel(spark, sf):
    return X.filled(X.panel(spark, sf))


SHARES = {
    "filled": "select site, unit, ts, coalesce(mw, 0.0) as mw from panel",
    "shared": """select f.site, f.unit, f.ts, f.mw, coalesce(f.mw / nullif(s.total, 0), 0.0) as share
        from filled f join site_series s on s.site = f.site and s.ts = f.ts""",
}
SHARE_COLS = ["share"] + [f"share_lag{n}" for n in S.LAGS]


@REG.add("unit_lags_shares", rows_sql(f"""select site, unit, ts, mw, share, {sql_lags('mw')}, {sql_lags('share', prefix='share_lag')}
    from shared window w as (partition by site, unit order by ts)""", SHARE_COLS), SHARES)
def unit_lags_shares(spark, sf):
    return rounded(E.unit_lags_shares(filled_panel(spark, sf)))


@REG.add("units_running", "select site, ts, units_running, case when units_running > 0 then 1 else 0 end as plant_available from site_series")
def units_running(spark, sf):
    return E.units_running(X.panel(spark, sf))


@REG.add("upstream_features", f"""select d.site, l.* exclude (site), l.site as upstream_site from site_dim d join
    (select site, ts, total as upstream_current, {sql_lags('total', prefix='upstream_gen_lag')} from site_series {W}) l
    on l.site = d.upstream_site""")
def upstream_features(spark, sf):
    edges = X.site_dim(spark, sf).select("site", "upstream_site")
    return E.upstream_features(X.site_series(spark, sf), edges)


@REG.add("hydro_lags", f"""select site, ts, {', '.join(f"{r6s(f'lag(level, {n}) over w')} as level_lag{n}" for n in S.HYDRO_LAGS)},
    {', '.join(f"{r6s(f'lag(rain, {n}) over w')} as rain_lag{n}" for n in S.HYDRO_LAGS)}
    from (select g.site, g.ts, g.level, c.rain from level_grid g left join daily_context c on c.d = cast(g.ts as date)) {W}""")
def hydro_lags(spark, sf):
    g = X.level_grid(spark, sf).withColumn("d", F.to_date("ts")).join(X.daily_context(spark, sf), "d", "left")
    return rounded(E.hydro_lags(g, ["site"], ["level", "rain"]))


def feature_frame(spark, sf):
    """Site features with the unit count attached."""
    return E.site_features(X.site_series(spark, sf))


FEATURES = (
    ["units_running", "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos", "is_weekend"]
    + ["target_hour_sin", "target_hour_cos", "target_day_sin", "target_day_cos", "target_is_weekend", "current"]
    + [f"lag{n}" for n in S.LAGS] + [f"roll{s}{n}" for n in S.ROLL_WINDOWS for s in ("mean", "std", "min", "max")]
    + [f"diff{n}" for n in S.DIFFS] + ["target_lag24", "target_lag168"]
)
FRAME = {
    "ff": f"""select site, ts, units_running, {sql_calendar('ts')}, {sql_calendar('ts + interval 1 hour', 'target_', False)}, total as current,
        {sql_lags('total')}, {sql_rolling()}, {', '.join(f'total - lag(total, {n}) over w as diff{n}' for n in S.DIFFS)},
        lag(total, 23) over w as target_lag24, lag(total, 167) over w as target_lag168 from site_series {W}"""
}


@REG.add("feature_select", " union all ".join(
    f"select '{n}' as feature, count({n}) as non_null_rows, cast({i} as integer) as position from ff" for i, n in enumerate(FEATURES)), FRAME)
def feature_select(spark, sf):
    f = feature_frame(spark, sf)
    names = E.feature_select(f.columns)
    counts = f.agg(*[F.count(n).alias(n) for n in names])
    order = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    tall = counts.unpivot([], names, "feature", "non_null_rows")
    return tall.withColumn("position", order[F.col("feature")])


SERVING = ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos", "is_weekend", *M.feature_names()]
_CALENDAR = [n for n in SERVING if n.split("target_")[-1] in SERVING[:7]]
ASOF = FRAME | {
    "fu": """select f.*, coalesce(p.total, 0.0) as upstream_current from ff f join site_dim d on d.site = f.site
        left join site_series p on p.site = d.upstream_site and p.ts = f.ts""",
    "fs": f"""select *, {sql_lags('upstream_current', prefix='upstream_gen_lag')}, case when units_running > 0 then 1 else 0 end as plant_available from fu {W}""",
    "newest": """select o.origin, f.* from fs f join (select site, origin, max(ts) as ts from site_series join origins on ts < origin group by all) o on o.site = f.site and o.ts = f.ts""",
    "ahead": "select *, origin + (h - 1) * interval 1 hour as target from (select *, cast(unnest(range(1, 25)) as integer) as h from newest)",
}


@REG.add("serving_row", f"""select site, origin, h, {sql_calendar('target')}, {sql_calendar('target', 'target_', False)},
    {', '.join(f"{r6s(f'coalesce(cast({n} as double), 0.0)')} as {n}" for n in SERVING if n not in _CALENDAR)} from ahead""", ASOF)
def serving_row(spark, sf):
    """Every origin and step with the full list of model inputs."""
    series = cut_lineage(X.site_series(spark, sf))
    frame = M.model_frame(series, X.site_dim(spark, sf).select("site", "upstream_site"))
    return rounded(E.serving_rows(frame, SERVING, X.origins(spark, sf)))


# --- splits ----------------------------------------------------------------

@REG.add("chronological_split", """select site, split, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from (
    select site, ts, case when i < floor(n * 0.70) then 'train' when i < floor(n * (0.70 + 0.15)) then 'validation' else 'testing' end as split
    from (select site, ts, row_number() over (partition by site order by ts) - 1 as i, count(*) over (partition by site) as n from level))
    group by all""")
def chronological_split(spark, sf):
    s = P.chronological_split(X.level(spark, sf), ["site"])
    return s.groupBy("site", "split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@REG.add("full_days", "select site, cast(ts as date) as d from level group by all having count(distinct ts) = 24")
def full_days(spark, sf):
    return P.full_days(X.level(spark, sf), keys=("site",))


BACKTEST = {
    "btd": """select cast(ts as date) as d, case when ts < d0 + interval 21 day then 'train'
        when ts < d0 + interval 25 day then 'validation' else 'testing' end as split
        from site_series, day0 group by all having count(distinct ts) = 24"""
}


@REG.add("backtest_days", "select d, split from btd, day0 where split <> 'train' and d > d0", BACKTEST)
def backtest_days(spark, sf):
    v, t = X.cuts(spark, sf)
    return P.backtest_days(X.site_series(spark, sf).withColumn("split", P.cut_split("ts", v, t)))


@REG.add("sample_days", """select site, d from (select site, d, row_number() over (partition by site order by d) - 1 as i,
    count(*) over (partition by site) as n from (select distinct site, cast(ts as date) as d from level))
    where n <= 12 or list_contains([cast(round_even(k * (n - 1) / 11.0, 0) as bigint) for k in range(12)], i)""")
def sample_days(spark, sf):
    days = X.level(spark, sf).select("site", F.to_date("ts").alias("d")).distinct()
    return P.sample_days(days, ["site"])


# --- baselines -------------------------------------------------------------

@REG.add("persistence", "select site, ts, persistence as predicted from base where persistence is not null")
def persistence(spark, sf):
    s = X.site_series(spark, sf)
    return s.select("site", "ts", G.persistence("total", ["site"]).alias("predicted")).where("predicted is not null")


def _naive(hours):
    def run(spark, sf):
        s = X.site_series(spark, sf)
        return s.select("site", "ts", G.seasonal_naive("total", ["site"], hours).alias("predicted")).where("predicted is not null")

    return run


for _h in (24, 168):
    REG.add(f"seasonal_naive_{_h}", f"""select a.site, a.ts, b.total as predicted from site_series a
        join site_series b on b.site = a.site and b.ts = a.ts - interval {_h} hour""")(_naive(_h))


@REG.add("naive24_leaderboard", rows_sql(f"""select s.site, count(*) as n, {metric_sql('s.total', 'p.total', 'c.capacity')}
    from site_series s join site_series p on p.site = s.site and p.ts = s.ts - interval 1 day
    join full_days f on f.d = cast(s.ts as date) join site_dim c on c.site = s.site group by s.site""",
    ["operational_mape", "mae", "rmse", "r2"]))
def naive24_leaderboard(spark, sf):
    s = X.site_series(spark, sf)
    pairs = s.select("site", "ts", F.col("total").alias("actual"), G.seasonal_naive("total", ["site"], 24).alias("predicted"))
    whole = F.count("ts").over(series_window(["site"], F.to_date("ts")).rangeBetween(0, 0)) == S.HORIZON
    scored = pairs.withColumn("full", whole).where("full and predicted is not null")
    cap = X.site_dim(spark, sf).select("site", "capacity")
    return rounded(scored.join(cap, "site").groupBy("site").agg(F.count(F.lit(1)).alias("n"), *metric_columns()))


# --- many series, long histories -------------------------------------------

MANY = {
    "sd": """select l_suppkey as site, cast(cast(l_shipdate as date) as timestamp) as ts,
        cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total from lineitem group by all""",
    "sdb": "select min(ts) as lo, max(ts) as hi from sd",
    "sspine": "select unnest(generate_series(lo, hi, interval 1 day)) as ts from sdb",
    "skeys": "select distinct site from sd",
    "sgrid": """select k.site, s.ts, coalesce(sd.total, 0) as total from skeys k cross join sspine s
        left join sd on sd.site = k.site and sd.ts = s.ts""",
    "sfeat": """select site, ts, total, lag(total, 7) over w as lag7, avg(total) over (partition by site order by ts rows 27 preceding) as mean28,
        count(total) over (partition by site order by ts rows 27 preceding) as n28 from sgrid window w as (partition by site order by ts)""",
}


def supplier_days(spark, sf):
    """Daily value per supplier on the complete calendar: one series per supplier."""
    li = X.read(spark, sf, "lineitem").withColumn("ts", F.to_date("l_shipdate").cast("timestamp_ntz"))
    daily = li.groupBy(F.col("l_suppkey").alias("site"), "ts").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    ends = li.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.approx_count_distinct("l_suppkey").alias("n"))
    size = ends.select("n", (F.datediff("hi", "lo") + 1).alias("days")).first()
    parts = D.grid_parts(size["n"], size["days"] or 0, spark.sparkContext.defaultParallelism)
    grid = D.complete_grid(daily, ["site"], bounds=ends, step="1 day", parts=parts)
    return grid.withColumn("total", F.coalesce("total", F.lit(0.0)))


@REG.add("many_series_leaderboard", rows_sql(f"""select site, count(*) as n, avg(mean28) as mean28, {metric_sql('total', 'lag7', '0')}
    from sfeat where lag7 is not null and n28 >= 14 group by site""", ["mean28", "operational_mape", "mae", "rmse", "r2"]), MANY)
def many_series_leaderboard(spark, sf):
    """Week-ago forecast and rolling level for every supplier series."""
    s = supplier_days(spark, sf)
    r = E.rolling_stats(s, ["site"], "total", windows=[7, 28])
    f = r.select("site", F.col("total").alias("actual"), *E.lags("total", series_window(["site"]), [7]), "rollmean28")
    scored = f.where("lag7 is not null and rollmean28 is not null").withColumnRenamed("lag7", "predicted").withColumn("capacity", F.lit(0.0))
    return rounded(scored.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.avg("rollmean28").alias("mean28"), *metric_columns()))


@REG.add("long_history_leaderboard", rows_sql(f"""select site, count(*) as n, {metric_sql('total', 'p', '0')} from (
    select site, total, lag(total, 7) over (partition by site order by ts) as p from (
      select o_orderpriority as site, cast(o_orderdate as date) as ts, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by all))
    where p is not null group by site""", ["operational_mape", "mae", "rmse", "r2"]))
def long_history_leaderboard(spark, sf):
    """Seven reports back, per order priority, over the whole order history."""
    o = X.read(spark, sf, "orders")
    d = o.groupBy(F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("ts")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("actual")
    )
    p = d.withColumn("predicted", F.lag("actual", 7).over(series_window(["site"]))).where("predicted is not null").withColumn("capacity", F.lit(0.0))
    return rounded(p.groupBy("site").agg(F.count(F.lit(1)).alias("n"), *metric_columns()))
