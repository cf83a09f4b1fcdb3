"""Registered queries: calibration on validation rows.

The rows predict one hour ahead; the raw change is last week's value of the
target hour minus the current value, so no trained model is needed.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import add_hours, cap_clip, metric_columns, r6, series_window
from ..operators import calibration as H
from ..operators import splits as P
from ..session import cut_lineage
from . import fixtures as X
from .fixtures import metric_sql, r6s, score_sql, thr
from .q_features import rounded
from .registry import Registry

REG = Registry()


def calibration_rows(spark, sf, split="validation", p=None):
    p = X.stored_panel(spark, sf) if p is None else p
    v, t = X.cuts(spark, sf, p)
    w = series_window(["site"])
    s = X.site_series(spark, sf, p)
    rows = s.select(
        "site", "ts", (F.hour(add_hours("ts", 1)) + 1).alias("target_hour"), F.col("total").alias("current"),
        (F.lag("total", 167).over(w) - F.col("total")).alias("delta"), F.lead("total").over(w).alias("actual"),
        F.lag("total", 23).over(w).alias("anchor"),
    ).where(P.cut_split("ts", v, t) == split).dropna()
    cap = X.site_dim(spark, sf, p).select("site", "capacity")
    # The fits read this small slice many times: materialise it once.
    return cut_lineage(rows.join(cap, "site"))


def with_pred(spark, sf):
    """Rows with the uncalibrated half-step prediction as ``pred``."""
    return half_step(calibration_rows(spark, sf))


def half_step(rows):
    return rows.withColumn("pred", H.level_from_delta(shrinkage=0.5))


def clip_sql(x: str, cap: str = "capacity") -> str:
    return f"case when {x} is not null then least(greatest({x}, 0.0), {S.CAPACITY_HEADROOM} * {cap}) end"


def values(name: str, items: list) -> str:
    return "values " + ", ".join(f"({i}, {v})" for i, v in items)


CAL: dict[str, str] = {
    "cr0": """select site, ts, cast(hour(ts + interval 1 hour) + 1 as integer) as target_hour, total as current,
        lag(total, 167) over w - total as delta, lead(total) over w as actual, lag(total, 23) over w as anchor
        from site_series window w as (partition by site order by ts)""",
    "cr": """select cr0.*, d.capacity from cr0 join site_dim d on d.site = cr0.site cross join day0
        where ts >= d0 + interval 21 day and ts < d0 + interval 25 day
        and delta is not null and actual is not null and anchor is not null""",
    "cp": f"select *, {clip_sql('current + 0.5 * delta')} as pred from cr",
    # shrinkage and bias
    "sg(k, shrinkage)": values("sg", [(i + 1, s) for i, s in enumerate(S.SHRINKAGE_GRID)]),
    "sr": f"select cr.*, k, cast(shrinkage as double) as shrinkage, {clip_sql('current + shrinkage * delta')} as raw from cr cross join sg",
    "sb": f"""select site, k, greatest(-max({thr()}), least(max({thr()}), median(actual - raw))) as bias from sr group by site, k""",
    "sm": f"""select site, k, shrinkage, bias, {metric_sql('actual', 'cand')} from (
        select sr.*, bias, {clip_sql('raw + bias')} as cand from sr join sb on sb.site = sr.site and sb.k = sr.k) group by all""",
    "sfit": f"select * from (select *, {score_sql()} from sm) qualify row_number() over (partition by site order by s1, s2, s3, s4, k) = 1",
    # value bins on cp
    "bl": "select site, list(round(current, 9) order by current) as v, count(*) as n from cp group by site",
    "bq": f"select unnest(range({S.BIN_QUANTILES[0]}, {S.BIN_QUANTILES[-1] + 1})) as q",
    "be": """select site, cast(q as integer) as q, list_sort(list_distinct([round(v[cast(floor(r) as int) + 1] + (r - floor(r)) *
        (v[cast(ceil(r) as int) + 1] - v[cast(floor(r) as int) + 1]), 9)
        for r in [cast(i as double) * (n - 1) / q for i in range(0, q + 1)]])) as edges from bl cross join bq""",
    "bb": """select cp.*, q, edges, len(list_filter(edges[2:len(edges) - 1], lambda e : e <= round(current, 9))) as bin
        from cp join be on be.site = cp.site""",
    "bm": "select site, q, bin, median(actual - pred) as shift from bb group by all",
    "bs(j, scale)": values("bs", [(i + 1, f"cast({s} as double)") for i, s in enumerate(S.BIN_SCALES)]),
    "bc": f"""select bb.site, bb.q * 1000 + j as k, bb.q, scale, {metric_sql('actual', clip_sql('(pred + scale * shift)'))}
        from bb join bm on bm.site = bb.site and bm.q = bb.q and bm.bin = bb.bin cross join bs group by all
        union all select site, 0, null, null, {metric_sql('actual', 'pred')} from cp group by site""",
    "bfit": f"select * from (select *, {score_sql()} from bc) qualify row_number() over (partition by site order by s1, s2, s3, s4, k) = 1",
    "bapply": f"""select cp.* exclude (pred), case when f.scale is null then pred else {clip_sql('(pred + f.scale * coalesce(m.shift, 0))')} end as pred
        from cp join bfit f on f.site = cp.site
        left join (select site, ts, q, bin from bb) bb on bb.site = cp.site and bb.ts = cp.ts and bb.q = f.q
        left join bm m on m.site = cp.site and m.q = f.q and m.bin = bb.bin""",
    # hour of day
    "hmed": f"""select site, target_hour, greatest(-max(greatest(1.0, {S.HOURLY_CLIP_SHARE} * capacity)),
        least(max(greatest(1.0, {S.HOURLY_CLIP_SHARE} * capacity)), median(actual - pred))) as shift from cp group by all""",
    "hg(k, scale)": values("hg", [(i + 1, f"cast({s} as double)") for i, s in enumerate(S.HOURLY_SCALES)]),
    "hc": f"""select c.site, k, scale, {metric_sql('actual', clip_sql('(pred + scale * shift)'))} from cp c
        join hmed m on m.site = c.site and m.target_hour = c.target_hour cross join hg group by all
        union all select site, 0, null, {metric_sql('actual', 'pred')} from cp group by site""",
    "hfit": f"select * from (select *, {score_sql()} from hc) qualify row_number() over (partition by site order by s1, s2, s3, s4, k) = 1",
    # profile blend
    "pg(k, w)": values("pg", [(i + 1, f"cast({s} as double)") for i, s in enumerate(S.PROFILE_WEIGHTS)]),
    "pc": f"""select site, k, w, {metric_sql('actual', clip_sql('((1 - w) * pred + w * anchor)'))} from cp cross join pg group by all
        union all select site, 0, null, {metric_sql('actual', 'pred')} from cp group by site""",
    "pfit": f"select * from (select *, {score_sql()} from pc) qualify row_number() over (partition by site order by s1, s2, s3, s4, k) = 1",
    # level anchor
    "ag(k, cw, w)": "values " + ", ".join(
        f"({i + 1}, cast({c} as double), cast({w} as double))" for i, (c, w) in enumerate((c, w) for c in S.ANCHOR_WEIGHTS for w in S.ANCHOR_WEIGHTS)),
    "ac": f"""select site, k, cw, w, {metric_sql('actual', clip_sql('((1 - least(w, 0.85)) * pred + least(w, 0.85) * (cw * current + (1 - cw) * anchor))'))}
        from cp cross join ag group by all union all select site, 0, null, null, {metric_sql('actual', 'pred')} from cp group by site""",
    "afit": f"select * from (select *, {score_sql(S.R2_WEIGHT_RIVAL)} from ac) qualify row_number() over (partition by site order by s1, s2, s3, s4, k) = 1",
    # ramps
    "rd": """select site, abs(total - lag(total) over (partition by site order by ts)) as d from (
        select * from site_series, day0 where ts < d0 + interval 21 day)""",
    "ramps": f"select site, case when count(d) = 0 then 2.0 else greatest(1.0, quantile_cont(d, {S.RAMP_QUANTILE})) end as ramp from rd group by site",
}

def fit_out(df, *cols):
    return rounded(df.select("site", *cols, "s1"))


@REG.add("level_from_delta", f"select site, ts, {r6s(clip_sql('(current + 0.75 * delta + 1.5)'))} as pred from cr", CAL)
def level_from_delta(spark, sf):
    return calibration_rows(spark, sf).select("site", "ts", r6(H.level_from_delta(shrinkage=0.75, bias=1.5)).alias("pred"))


@REG.add("fit_shrinkage_bias", f"select site, shrinkage, {r6s('bias')} as bias, {r6s('s1')} as s1 from sfit", CAL)
def fit_shrinkage_bias(spark, sf):
    return fit_out(H.fit_shrinkage_bias(calibration_rows(spark, sf)), "shrinkage", "bias")


@REG.add("fit_bin_calibration", f"select f.site, f.q, f.scale, cast(len(e.edges) as integer) as n_edges, {r6s('f.s1')} as s1 from bfit f left join be e on e.site = f.site and e.q = f.q", CAL)
def fit_bin_calibration(spark, sf):
    fit = H.fit_bin_calibration(with_pred(spark, sf))
    return rounded(fit.select("site", "q", "scale", F.when(F.col("edges").isNotNull(), F.size("edges")).alias("n_edges"), "s1"))


@REG.add("apply_bin_calibration", f"select site, ts, {r6s('pred')} as pred from bapply", CAL)
def apply_bin_calibration(spark, sf):
    rows = with_pred(spark, sf)
    return rounded(H.apply_bin_calibration(rows, H.fit_bin_calibration(rows)).select("site", "ts", "pred"))


# One site with its bins on the base prediction and up to 40 of them; the same SQL on that basis.
OWN_BINS = "purchase"
_OWN = ("cp", "bl", "bq", "be", "bb", "bm", "bc", "bfit", "bapply")


def _own(sql: str) -> str:
    """The definition of a bin table over the tables of sites with rules of their own."""
    sql = sql.replace("order by current", "order by basis").replace("round(current, 9)", "round(basis, 9)")
    sql = sql.replace(f"range({S.BIN_QUANTILES[0]}, {S.BIN_QUANTILES[-1] + 1})", f"range({S.BIN_QUANTILES_WIDE[0]}, {S.BIN_QUANTILES_WIDE[-1] + 1})")
    sql = sql.replace("from bl cross join bq", f"from bl cross join bq where q <= {S.BIN_QUANTILES[-1]} or site = '{OWN_BINS}'")
    return re.sub(rf"\b({'|'.join(_OWN)})\b", r"\1_own", sql)


OWN = CAL | {"cp_own": f"select *, case when site = '{OWN_BINS}' then pred else current end as basis from cp"}
OWN |= {f"{n}_own": _own(CAL[n]) for n in _OWN if n != "cp"}


def bin_rules(spark, sf):
    return X.site_dim(spark, sf).select("site", F.when(F.col("site") == OWN_BINS, "pred").otherwise("current").alias("basis"), (F.col("site") == OWN_BINS).alias("wide"))


@REG.add("bin_calibration_by_site", f"""select f.site, case when f.site = '{OWN_BINS}' then 'pred' else 'current' end as basis, f.q, f.scale, cast(len(e.edges) as integer) as n_edges,
    {r6s('f.s1')} as s1 from bfit_own f left join be_own e on e.site = f.site and e.q = f.q""", OWN)
def bin_calibration_by_site(spark, sf):
    fit = H.fit_bin_calibration_by_site(with_pred(spark, sf), bin_rules(spark, sf))
    return rounded(fit.select("site", "basis", "q", "scale", F.when(F.col("edges").isNotNull(), F.size("edges")).alias("n_edges"), "s1"))


@REG.add("apply_bins_by_site", f"select site, ts, {r6s('pred')} as pred from bapply_own", OWN)
def apply_bins_by_site(spark, sf):
    rows = with_pred(spark, sf)
    return rounded(H.apply_bin_calibration(rows, H.fit_bin_calibration_by_site(rows, bin_rules(spark, sf))).select("site", "ts", "pred"))


@REG.add("apply_level_anchor", f"""select cp.site, cp.ts, {r6s(f"case when f.k = 0 then pred else {clip_sql('((1 - least(f.w, 0.85)) * pred + least(f.w, 0.85) * (f.cw * current + (1 - f.cw) * anchor))')} end")} as pred
    from cp join afit f on f.site = cp.site""", CAL)
def apply_level_anchor(spark, sf):
    rows = with_pred(spark, sf)
    return rounded(H.apply_level_anchor_blend(rows, H.fit_level_anchor_blend(rows)).select("site", "ts", "pred"))


@REG.add("fit_hourly_correction", f"""select f.site, f.scale, {r6s('f.s1')} as s1, (select count(*) from hmed m where m.site = f.site) as hours,
    {r6s('(select sum(shift) from hmed m where m.site = f.site)')} as shift_sum from hfit f""", CAL)
def fit_hourly_correction(spark, sf):
    fit = H.fit_hourly_correction(with_pred(spark, sf))
    total = F.aggregate(F.map_values("corrections"), F.lit(0.0), lambda a, v: a + v)
    return rounded(fit.select("site", "scale", "s1", F.size("corrections").cast("bigint").alias("hours"), total.alias("shift_sum")))


@REG.add("profile_blend", f"select site, w as blend_weight, {r6s('s1')} as s1 from pfit", CAL)
def profile_blend(spark, sf):
    return fit_out(H.fit_profile_blend(with_pred(spark, sf)), "blend_weight")


@REG.add("level_anchor_blend", f"select site, cw as current_weight, w as anchor_weight, {r6s('s1')} as s1 from afit", CAL)
def level_anchor_blend(spark, sf):
    return fit_out(H.fit_level_anchor_blend(with_pred(spark, sf)), "current_weight", "anchor_weight")


def train_ramps(spark, sf, p=None):
    v, _ = X.cuts(spark, sf, p)
    return H.ramp_limit(X.site_series(spark, sf, p).where(F.col("ts") < v))


@REG.add("ramp_limit", f"select site, {r6s('ramp')} as ramp from ramps", CAL)
def ramp_limit(spark, sf):
    return rounded(train_ramps(spark, sf))


SCORES = {"vm": f"select model, site, {metric_sql()} from predictions where split = 'validation' group by model, site"}
SCORE_OUT = ", ".join(f"{r6s(f's{i}')} as s{i}" for i in range(1, 5))


@REG.add("candidate_score", f"select model, site, {SCORE_OUT} from (select model, site, {score_sql()} from vm)", SCORES)
def candidate_score(spark, sf):
    p = X.predictions(spark, sf).where("split = 'validation'")
    scored = H.candidate_score(p.groupBy("model", "site").agg(*metric_columns()))
    return rounded(scored.select("model", "site", "s1", "s2", "s3", "s4"))


BLEND = {
    "tg(k, w)": "values " + ", ".join(f"({i}, cast({w} as double))" for i, w in enumerate([0.0, *S.SAVED_BLEND_WEIGHTS])),
    "tr": """select p.*, s.total as anchor from predictions p join site_series s on s.site = p.site and s.ts = p.ts - interval 1 day
        where p.split = 'validation'""",
    "tm": f"""select model, site, k, w, {metric_sql('actual', f"(case when k = 0 then predicted else {clip_sql('((1 - w) * predicted + w * anchor)')} end)")}
        from tr cross join tg group by all""",
    "tb": f"""select * from (select *, {score_sql()}, max(case when k = 0 then rmse end) over (partition by model, site) as rmse0,
        max(case when k = 0 then r2 end) over (partition by model, site) as r20 from tm)
        qualify row_number() over (partition by model, site order by s1, s2, s3, s4, k) = 1""",
}


@REG.add("tune_saved_blend", f"""select model, site, w as weight, {r6s('rmse0')} as rmse_before, {r6s('rmse')} as rmse_after,
    coalesce(k > 0 and rmse <= rmse0 and r2 >= r20, false) as adopted from tb""", BLEND)
def tune_saved_blend(spark, sf):
    p = X.predictions(spark, sf).where("split = 'validation'")
    return rounded(H.tune_saved_blend(p, X.site_series(spark, sf)))


CHAIN = {
    "c1": f"select cr.*, {clip_sql('(current + f.shrinkage * delta + f.bias)')} as pred from cr join sfit f on f.site = cr.site",
    "c2": f"""select c1.* exclude (pred), case when f.scale is null then pred else {clip_sql('(pred + f.scale * coalesce(m.shift, 0))')} end as pred
        from c1 join bfit f on f.site = c1.site left join (select site, ts, q, bin from bb) bb on bb.site = c1.site and bb.ts = c1.ts and bb.q = f.q
        left join bm m on m.site = c1.site and m.q = f.q and m.bin = bb.bin""",
    "c3": f"""select c2.* exclude (pred), case when f.scale is null then pred else {clip_sql('(pred + f.scale * coalesce(m.shift, 0))')} end as pred
        from c2 join hfit f on f.site = c2.site left join hmed m on m.site = c2.site and m.target_hour = c2.target_hour""",
    "c4": f"""select c3.* exclude (pred), case when f.w is null then pred else {clip_sql('((1 - f.w) * pred + f.w * anchor)')} end as pred
        from c3 join pfit f on f.site = c3.site""",
    "c5": f"""select c4.site, c4.ts, {clip_sql('least(greatest(pred, current - ramp), current + ramp)')} as pred
        from c4 join ramps on ramps.site = c4.site""",
}


@REG.add("pipeline_order", f"select site, ts, {r6s('pred')} as pred from c5", CAL | CHAIN)
def pipeline_order(spark, sf):
    p = X.stored_panel(spark, sf)
    rows = calibration_rows(spark, sf, p=p)
    half = half_step(rows)
    out = H.pipeline_order(
        rows, H.fit_shrinkage_bias(rows), H.fit_bin_calibration(half), H.fit_hourly_correction(half),
        H.fit_profile_blend(half), train_ramps(spark, sf, p),
    )
    return rounded(out.select("site", "ts", "pred"))
