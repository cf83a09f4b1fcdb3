"""Registered queries: models, rollouts and backtests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import constant_array, metric_columns, r6, series_window
from ..operators import calibration as H
from ..operators import features as E
from ..operators import models as M
from ..operators import outage as I
from ..operators import rollout as J
from ..operators import selection as Z
from ..operators import splits as P
from ..operators import trees as T
from ..session import cut_lineage
from ..sources import model_store as K
from ..sources.tables import scratch
from . import fixtures as X
from . import q_calibration as QC
from . import q_outage as QO
from .fixtures import metric_sql, r6s
from .q_features import BACKTEST, rounded
from .registry import Registry

REG = Registry()
SMALL = ["current", "lag1", "lag24"]


# --- scaling and basis functions -------------------------------------------

SCALE = {
    "sx": """select site, ts, total as current, lag(total, 1) over w as lag1, lag(total, 24) over w as lag24 from site_series
        window w as (partition by site order by ts)""",
    "sc": "select * from sx where lag24 is not null",
    "st": "select site, " + ", ".join(f"avg({c}) as m_{c}, case when stddev_pop({c}) > 0 then stddev_pop({c}) else 1 end as s_{c}" for c in SMALL)
          + " from sc cross join day0 where ts < d0 + interval 21 day group by site",
}


def small_rows(spark, sf):
    w = series_window(["site"])
    return X.site_series(spark, sf).select("site", "ts", F.col("total").alias("current"), *E.lags("total", w, [1, 24])).dropna()


@REG.add("standard_scale", "select sc.site, sc.ts, " + ", ".join(f"{r6s(f'({c} - m_{c}) / s_{c}')} as {c}" for c in SMALL)
         + " from sc join st on st.site = sc.site", SCALE)
def standard_scale(spark, sf):
    v, _ = X.cuts(spark, sf)
    rows = small_rows(spark, sf)
    scaled = M.standard_scale(rows, M.fit_scaler(rows.where(F.col("ts") < v), SMALL), SMALL)
    return scaled.select("site", "ts", *[r6(F.get("x", F.lit(i))).alias(c) for i, c in enumerate(SMALL)])


RBF = {
    "rx": "select site, ts, total / 100 as a, lag(total, 24) over (partition by site order by ts) / 100 as b from site_series",
    "rc": "select row_number() over (order by site) as i, avg(a) as ca, avg(b) as cb from rx where b is not null group by site",
}


@REG.add("rbf_expand", "select site, ts, " + ", ".join(f"{r6s(f'max(case when i = {i} then exp(-0.{i} * ((a - ca) * (a - ca) + (b - cb) * (b - cb))) end)')} as phi{i}" for i in range(1, 6))
         + " from rx cross join rc where b is not null group by site, ts", RBF)
def rbf_expand(spark, sf):
    w = series_window(["site"])
    rows = X.site_series(spark, sf).select("site", "ts", (F.col("total") / 100).alias("a"), (F.lag("total", 24).over(w) / 100).alias("b")).dropna()
    per = rows.groupBy("site").agg(F.array(F.avg("a"), F.avg("b")).alias("c"))
    sorted_ = per.agg(F.transform(F.sort_array(F.collect_list(F.struct("site", "c"))), lambda r: r["c"]).alias("cs"))
    rows = rows.withColumn("cs", sorted_.select("cs").scalar())
    phi = M.rbf_expand(F.array("a", "b"), F.col("cs"), F.array(*[F.lit(i / 10) for i in range(1, 6)]))
    return rows.withColumn("phi", phi).select("site", "ts", *[r6(F.get("phi", F.lit(i - 1))).alias(f"phi{i}") for i in range(1, 6)])


@REG.add("config_grid", "select distinct site, n_centers, learning_rate, gamma, batch_size, patience from site_dim join cfg on cfg.o = 0 or cfg.o = site_dim.ordinal", {
    "cfg(o, n_centers, learning_rate, gamma, batch_size, patience)": "values " + ", ".join(
        f"({o}, {c[0]}, cast({c[1]} as double), cast({c[2]} as double), {c[3]}, {c[4]})"
        for o, rows in {0: S.RBF_BASE_CONFIGS, **S.RBF_EXTRA_CONFIGS}.items() for c in rows)})
def config_grid(spark, sf):
    return M.config_grid(X.site_dim(spark, sf))


# --- training --------------------------------------------------------------

def edges(spark, sf):
    return X.site_dim(spark, sf).select("site", "upstream_site")


def training(spark, sf, series=None):
    """Model rows with every lag present, labelled by split, materialised."""
    v, t = X.cuts(spark, sf)
    frame = M.model_frame(cut_lineage(X.site_series(spark, sf)) if series is None else series, edges(spark, sf))
    need = ["lag168", "target_lag168", M.TARGET]
    return cut_lineage(frame.dropna(subset=need).withColumn("split", P.cut_split("ts", v, t)))


def radial_model(spark, sf, k: int = S.RBF_BASE_CONFIGS[0][0], series=None):
    """Radial model with centers and weights of each site: (model table, scaled rows)."""
    names = M.feature_names()
    rows = training(spark, sf, series)
    train = rows.where("split = 'train'")
    scaler = cut_lineage(M.fit_scaler(train, names))
    scaled = cut_lineage(M.standard_scale(rows, scaler, names))
    fit_rows = scaled.where("split = 'train'")
    model = M.rbf_regression(fit_rows, M.site_centers(fit_rows, k), gamma=S.RBF_BASE_CONFIGS[0][2] / len(names))
    return cut_lineage(model.join(scaler, "site")), scaled


@REG.add("kmeans_centers")
def kmeans_centers(spark, sf):
    names = M.feature_names()
    rows = training(spark, sf).where("split = 'train'")
    scaled = cut_lineage(M.standard_scale(rows, M.fit_scaler(rows, names), names))
    found = M.site_centers(scaled, S.RBF_BASE_CONFIGS[0][0])
    gap = lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = F.array_min(F.transform("centers", lambda c, i: F.struct(gap(c).alias("d"), i.alias("i"))))
    return scaled.join(found, "site").select("site", near.alias("n")).groupBy("site", F.col("n.i").alias("center")).agg(
        F.count(F.lit(1)).alias("rows"), r6(F.avg("n.d")).alias("mean_square_distance")
    )


# One round from the first three rows of each site, and a ridge fit of two inputs by Cramer's rule.
ROUND = {
    "sx": SCALE["sx"],
    "sc": "select site, ts, current / 100 as current, lag1 / 100 as lag1, lag24 / 100 as lag24 from sx where lag24 is not null",
    "c3": f"select site, row_number() over (partition by site order by ts) - 1 as i, {', '.join(SMALL)} from sc qualify i < 3",
    "near": f"""select sc.*, c3.i from sc join c3 on c3.site = sc.site
        qualify row_number() over (partition by sc.site, sc.ts order by {' + '.join(f'(sc.{c} - c3.{c}) * (sc.{c} - c3.{c})' for c in SMALL)}, c3.i) = 1""",
    "moved": "select site, i, " + ", ".join(f"avg({c}) as {c}" for c in SMALL) + " from near group by site, i",
}


def small_arrays(spark, sf):
    return small_rows(spark, sf).select("site", "ts", F.array(*[F.col(c) / 100 for c in SMALL]).alias("x"))


@REG.add("lloyd_round", "select c3.site, cast(c3.i as integer) as center, " + ", ".join(f"{r6s(f'coalesce(m.{c}, c3.{c})')} as {c}" for c in SMALL)
         + " from c3 left join moved m on m.site = c3.site and m.i = c3.i", ROUND)
def lloyd_round(spark, sf):
    rows = cut_lineage(small_arrays(spark, sf))
    first = rows.withColumn("r", F.row_number().over(series_window(["site"]))).where("r <= 3")
    start = cut_lineage(first.groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "x"))), lambda r: r["x"]).alias("centers")))
    out = M.lloyd_round(rows, start).select("site", F.posexplode("centers").alias("center", "c"))
    return out.select("site", "center", *[r6(F.get("c", F.lit(i))).alias(c) for i, c in enumerate(SMALL)])


RIDGE = {
    "sx": SCALE["sx"],
    "rows2": "select site, current / 100 as a, lag24 / 100 as b, (lead(current) over (partition by site order by ts) - current) / 100 as y from sx",
    "kept2": "select * from rows2 where a is not null and b is not null and y is not null",
    "g2": """select site, count(*) + 1e-9 as n, sum(a) as sa, sum(b) as sb, sum(y) as sy, sum(a * a) + 1 as aa, sum(a * b) as ab, sum(b * b) + 1 as bb,
        sum(a * y) as ay, sum(b * y) as byy, count(*) as cnt from kept2 group by site""",
    "det": "select *, n * (aa * bb - ab * ab) - sa * (sa * bb - ab * sb) + sb * (sa * ab - aa * sb) as d from g2",
}


@REG.add("ridge_fit", f"""select site, cnt as rows, {r6s('(sy * (aa * bb - ab * ab) - sa * (ay * bb - ab * byy) + sb * (ay * ab - aa * byy)) / d')} as c0,
    {r6s('(n * (ay * bb - ab * byy) - sy * (sa * bb - ab * sb) + sb * (sa * byy - ay * sb)) / d')} as c1,
    {r6s('(n * (aa * byy - ay * ab) - sa * (sa * byy - ay * sb) + sy * (sa * ab - aa * sb)) / d')} as c2 from det""", RIDGE)
def ridge_fit(spark, sf):
    """Normal equations of two inputs, the linear case of the radial model's output layer."""
    w = series_window(["site"])
    rows = X.site_series(spark, sf).select("site", (F.col("total") / 100).alias("a"), (F.lag("total", 24).over(w) / 100).alias("b"), ((F.lead("total").over(w) - F.col("total")) / 100).alias(M.TARGET)).dropna()
    fit = M.rbf_regression(rows.withColumn("x", F.array("a", "b")), [], gamma=1.0)
    return fit.select("site", "rows", *[r6(F.get("coef", F.lit(i))).alias(f"c{i}") for i in range(3)])


def delta_scores(df, model):
    scored = df.withColumn("actual", F.col("tplus1")).withColumn("predicted", F.greatest(F.col("current") + F.col("delta"), F.lit(0.0)))
    return scored.withColumn("capacity", F.lit(1.0)).groupBy(F.lit(model).alias("model"), "site", "split").agg(F.count(F.lit(1)).alias("n"), *metric_columns())


@REG.add("rbf_regression")
def rbf_regression(spark, sf):
    model, scaled = radial_model(spark, sf)
    return rounded(delta_scores(M.rbf_predict(scaled, model), "radial"))


def tree_search(spark, sf, family):
    """Every search point of the family for every site, and its scores by split."""
    rows, names = training(spark, sf), M.feature_names()
    points = T.search_points(family, X.site_dim(spark, sf))
    models = cut_lineage(T.fit(rows.where("split = 'train'"), names, family, points))
    scored = T.predict(rows.select("site", "split", "current", "tplus1", *[n for n in names if n != "current"]), models, names)
    scored = scored.withColumn("actual", F.col("tplus1")).withColumn("predicted", F.greatest(F.col("current") + F.col("delta"), F.lit(0.0))).withColumn("capacity", F.lit(1.0))
    return rounded(scored.groupBy("family", "point", "site", "split").agg(F.count(F.lit(1)).alias("n"), *metric_columns()))


@REG.add("random_forest")
def random_forest(spark, sf):
    return tree_search(spark, sf, "forest")


@REG.add("boosted_trees")
def boosted_trees(spark, sf):
    return tree_search(spark, sf, "boosting")


# Training in SQL: two rounds of stumps on inputs of few values, so that bins are the values themselves.
STUMP = ["hour", "weekday", "units_running"]
RATE, L2 = 0.5, 2.0


def _stump(i: int, last: str) -> dict[str, str]:
    """Tables of one round: residuals by input and value, the best split of each site, and the new prediction."""
    long = " union all ".join(f"select site, {j} as f, {c} as v, r from res{i}" for j, c in enumerate(STUMP))
    return {
        f"res{i}": f"select *, y - p{i} as r from {last}",
        f"cell{i}": f"select site, f, v, sum(r) as s, count(*) as n from ({long}) group by all",
        f"cut{i}": f"""select site, f, v, lead(v) over w as nv, sum(s) over w as sl, sum(n) over w as nl, sum(s) over (partition by site, f) as st, sum(n) over (partition by site, f) as nt
            from cell{i} window w as (partition by site, f order by v)""",
        f"best{i}": f"""select * from (select *, sl * sl / (nl + {L2}) + (st - sl) * (st - sl) / (nt - nl + {L2}) - st * st / (nt + {L2}) as gain from cut{i} where nv is not null)
            where gain > 1e-9 qualify row_number() over (partition by site order by round(gain, 6) desc, f, v) = 1""",
        f"pred{i + 1}": f"""select a.site, a.ts, {', '.join('a.' + c for c in STUMP)}, a.y, a.p{i} + {RATE} * coalesce(
            case when case b.f {' '.join(f'when {j} then a.{c}' for j, c in enumerate(STUMP))} end <= (b.v + b.nv) / 2 then b.sl / (b.nl + {L2}) else (b.st - b.sl) / (b.nt - b.nl + {L2}) end,
            m.s / (m.n + {L2})) as p{i + 1} from {last} a left join best{i} b on b.site = a.site join (select site, sum(r) as s, count(*) as n from res{i} group by site) m on m.site = a.site""",
    }


STUMPS = {
    "pred0": """select site, ts, cast(hour(ts) as double) as hour, cast(dayofweek(ts) as double) as weekday, cast(units_running as double) as units_running, total as y,
        avg(total) over (partition by site) as p0 from site_series""",
    **_stump(0, "pred0"), **_stump(1, "pred1"),
}


@REG.add("boosted_stumps", f"select site, ts, {r6s('p2')} as predicted from pred2", STUMPS)
def boosted_stumps(spark, sf):
    """Second-order boosting, two rounds of depth one, trained and applied on all rows."""
    rows = X.site_series(spark, sf).select("site", "ts", F.hour("ts").cast("double").alias("hour"), (F.dayofweek("ts") - 1).cast("double").alias("weekday"), F.col("units_running").cast("double").alias("units_running"), "total")
    rows = cut_lineage(rows)
    model = T.fit(rows, STUMP, "boosting", [(2, RATE, 1, 1.0, 1.0, L2)], y="total")
    return rounded(T.predict(rows, model, STUMP).select("site", "ts", F.col("delta").alias("predicted")))


# An exported ensemble of two trees: node, input, threshold, left, right, value.
EXPORT = [
    (0, 0, 40.0, 2, 3, 0.0), (1, 1, 25.5, 4, 5, 0.0), (2, 2, 30.25, 6, 7, 0.0), (3, -1, 0.0, -1, -1, -3.5),
    (4, -1, 0.0, -1, -1, 1.25), (5, 0, 90.0, 8, 9, 0.0), (6, -1, 0.0, -1, -1, 2.0), (7, -1, 0.0, -1, -1, -0.75), (8, -1, 0.0, -1, -1, 0.5), (9, -1, 0.0, -1, -1, -6.0),
]
EXPORT_BASE = 0.125
WALK = {
    "sx": SCALE["sx"], "sc": SCALE["sc"],
    "node(i, f, t, l, r, v)": "values " + ", ".join(str(n) for n in EXPORT),
    "walk": """select site, ts, current, lag1, lag24, 0 as recursive_step, root as i from sc cross join (select unnest([0, 1]) as root)
        union all select site, ts, current, lag1, lag24, recursive_step + 1, case when case f when 0 then current when 1 then lag1 else lag24 end <= t then l else r end
        from walk join node using (i) where f >= 0""",
}


@REG.add("tree_arrays", f"select site, ts, {r6s(f'{EXPORT_BASE} + sum(v)')} as delta from walk join node using (i) where f < 0 group by site, ts", WALK)
def tree_arrays(spark, sf):
    """Predictions of a stored ensemble, every leaf found by SQL on the other side."""
    rows = cut_lineage(small_rows(spark, sf))
    cols = list(zip(*[n[1:] for n in EXPORT], strict=True))
    arrays = [F.array(*[F.lit(v) for v in c]).cast(t).alias(n) for n, c, t in zip(("feature", "threshold", "left", "right", "value"), cols, ("array<int>", "array<double>", "array<int>", "array<int>", "array<double>"), strict=True)]
    model = rows.select("site").distinct().select("site", F.lit("forest").alias("family"), F.lit(1).alias("point"), F.lit(EXPORT_BASE).alias("base"), F.lit(0).cast("long").alias("rows"), *arrays, F.array(F.lit(0), F.lit(1)).alias("roots"))
    return rounded(T.predict(rows, model, SMALL).select("site", "ts", "delta"))


@REG.add("predict_delta")
def predict_delta(spark, sf):
    model, scaled = radial_model(spark, sf)
    return rounded(M.rbf_predict(scaled.where("split = 'testing'"), model).select("site", "ts", "delta"))


@REG.add("model_store")
def model_store(spark, sf):
    """Save the three families, reload, and compare the predictions of both copies; other inputs make the store train again.

    The radial model goes in first and the trees beside it, so the last version holds what two saves brought.
    """
    names, path = M.feature_names(), scratch(spark, "models")
    radial, scaled = radial_model(spark, sf)
    rows = training(spark, sf)
    train = rows.where("split = 'train'")
    grow = lambda inputs: reduce(DataFrame.unionByName, [T.fit(train, inputs, f, [c]) for f, c in (("forest", S.FOREST_CONFIGS[0]), ("boosting", S.BOOSTING_CONFIGS[0]))])
    trees, calibration = cut_lineage(grow(names)), cut_lineage(fitted(spark, sf))
    K.save_models(radial.withColumn("family", F.lit("radial")), names, path, calibration)
    K.save_models(trees, names, path, calibration)
    again, inputs, retrained = K.load_models(spark, path, names)
    tested = scaled.where("split = 'testing'")
    plain = rows.where("split = 'testing'").select("site", "ts", *names)
    of_trees = lambda models, cols: T.predict(plain, models, cols).select("family", "site", "ts", "delta")
    of_radial = lambda m: M.rbf_predict(tested, m).select(F.lit("radial").alias("family"), "site", "ts", "delta")
    before = of_trees(trees, names).unionByName(of_radial(radial)).withColumnRenamed("delta", "before")
    stored = reduce(DataFrame.unionByName, [K.family(again, f) for f in ("forest", "boosting")])
    after = of_trees(stored, inputs).unionByName(of_radial(K.family(again, "radial"))).withColumnRenamed("delta", "after")
    _, fewer, anew = K.load_models(spark, path, SMALL, lambda: grow(SMALL))
    return before.join(after, ["family", "site", "ts"]).groupBy("family", "site").agg(
        F.count(F.lit(1)).alias("rows"), r6(F.max(F.abs(F.col("before") - F.col("after")))).alias("largest_difference")
    ).withColumns({"retrained": F.lit(retrained), "retrained_on_other_inputs": F.lit(anew), "inputs": F.lit(len(fewer))})


STORED = QC.CAL | QC.BLEND


@REG.add("serving_calibration", f"""select f.site, f.w as fitted_blend, case when t.k > 0 and t.rmse <= t.rmse0 and t.r2 >= t.r20 then t.w end as saved_blend,
    coalesce(case when t.k > 0 and t.rmse <= t.rmse0 and t.r2 >= t.r20 then t.w end, f.w) as blend_weight
    from pfit f left join tb t on t.site = f.site and t.model = 'naive24'""", STORED)
def serving_calibration(spark, sf):
    """A stored blend overrides the fitted one once a model is served from the store."""
    rows, path = QC.with_pred(spark, sf), scratch(spark, "models")
    shrink = cut_lineage(H.fit_shrinkage_bias(rows))
    fit = cut_lineage(J.pack_calibration(shrink, profile=H.fit_profile_blend(rows)))
    tuned = H.tune_saved_blend(X.predictions(spark, sf).where("split = 'validation'"), X.site_series(spark, sf))
    model, _ = linear_tables(X.site_dim(spark, sf))
    K.save_models(model.withColumn("family", F.lit("radial")), M.feature_names(), path, K.with_saved_blend(fit, tuned, "naive24"))
    stored, _, _ = K.load_models(spark, path, M.feature_names())
    served = K.serving_calibration(stored, "radial").select("site", "blend_weight")
    return stored.select("site", F.col("blend_weight").alias("fitted_blend"), "saved_blend").join(served, "site")


# --- rollouts --------------------------------------------------------------

class Bench:
    """Panel tables every rollout needs, read once per query."""

    def __init__(self, spark, sf, splits=("validation", "testing")):
        v, t = X.cuts(spark, sf)
        stored = X.stored_panel(spark, sf)
        self.units = X.filled(stored)
        self.series = cut_lineage(X.site_series(spark, sf, stored))
        self.unit_dim, self.site_dim = cut_lineage(X.unit_dim(spark, sf)), cut_lineage(X.site_dim(spark, sf))
        days = P.backtest_days(self.series.withColumn("split", P.cut_split("ts", v, t)))
        self.days = cut_lineage(days.where(F.col("split").isin(*splits)))
        self.origins = self.days.select(F.col("d").cast("timestamp_ntz").alias("origin"))
        self.plan = I.outage_plan_last_known(self.units.select("site", "unit", "ts", "available"), self.origins)

    def states(self, members, calibration=None, model=None, keys=("site",), plan=None, model_keys=("site",)):
        return J.states(members, self.series, self.units, self.unit_dim, self.plan if plan is None else plan,
                        self.origins, model, calibration, keys, model_keys)

    def scored(self, forecast):
        rows = J.attach_actuals(forecast, self.series).join(self.site_dim.select("site", "capacity"), "site")
        return rows.withColumn("d", F.to_date("origin")).join(self.days, "d")


def fitted(spark, sf):
    rows = QC.calibration_rows(spark, sf)
    shrink = cut_lineage(H.fit_shrinkage_bias(rows))
    base = cut_lineage(H.apply_shrinkage_bias(rows, shrink))
    packed = J.pack_calibration(shrink, H.fit_bin_calibration(base), H.fit_hourly_correction(base), H.fit_profile_blend(base), QC.train_ramps(spark, sf))
    return cut_lineage(packed)


@REG.add("rollout_persistence", f"""select b.site, o.origin, cast(h + 1 as integer) as h, {r6s('b.total')} as predicted
    from site_series b join origins o on b.ts = o.origin - interval 1 hour
    cross join (select unnest(range(24)) as h) join btd on btd.d = cast(o.origin as date) and btd.split <> 'train'""", BACKTEST)
def rollout_persistence(spark, sf):
    """No model, no calibration, all units available: the last value, 24 times."""
    b = Bench(spark, sf)
    plan = b.plan.withColumn("available", F.lit(1))
    out = J.rollout_24h(b.states(J.whole_cascade(b.site_dim), plan=plan))
    return rounded(out.select("site", "origin", "h", "predicted"))


# A model and a calibration given as numbers, so that SQL can roll the same 24 hours.
LINEAR = {
    "intercept": 0.75, "target_hour_sin": 1.5, "current": -0.25, "lag1": 0.125, "lag24": 0.0625, "rollmean24": 0.125, "rollmin3": 0.0625,
    "diff1": 0.125, "target_lag24": 0.125, "target_lag168": 0.0625, "upstream_current": 0.03125,
}
FIXED = {"shrinkage": 0.75, "bias": 0.5, "hour_scale": 0.5, "blend_weight": 0.2, "anchor_weight": 0.25, "anchor_current": 0.5, "ramp": 60.0}
HOUR_SHIFT = [(h - 11.5) / 8 for h in range(24)]


def linear_tables(site_dim):
    """(model, calibration): the same numbers for every site."""
    names = M.feature_names()
    coef = [LINEAR["intercept"], *[LINEAR.get(n, 0.0) for n in names]]
    model = site_dim.select(
        "site", constant_array(coef).alias("coef"), F.array().cast("array<double>").alias("centers"),
        constant_array([0.0] * len(names)).alias("mean"), constant_array([1.0] * len(names)).alias("std"), F.lit(1.0).alias("gamma"),
    )
    return model, site_dim.select("site", *[F.lit(v).alias(k) for k, v in FIXED.items()], constant_array(HOUR_SHIFT).alias("hour_shift"))


def linear_rollouts(spark, sf):
    """The fixed model as whole cascades and as single sites, every unit available: (bench, forecast with ``kind``)."""
    b = Bench(spark, sf)
    model, calibration = linear_tables(b.site_dim)
    kinds = [m(b.site_dim).withColumn("cascade", F.concat(F.lit(f"{k}|"), "cascade")) for k, m in (("cascade", J.whole_cascade), ("plant", J.single_sites))]
    members = cut_lineage(reduce(DataFrame.unionByName, kinds))
    out = J.rollout_24h(b.states(members, calibration, model, plan=b.plan.withColumn("available", F.lit(1))))
    return b, out.withColumn("kind", F.split("cascade", r"\|")[0])


_cap = lambda x: f"least(greatest({x}, 0.0), {S.CAPACITY_HEADROOM} * capacity)"
_w = LINEAR
ROLL = BACKTEST | {
    "past": """select s.site, o.origin, list(s.total order by s.ts) as hist from site_series s join origins o on s.ts < o.origin and s.ts >= o.origin - interval 240 hour
        join btd on btd.d = cast(o.origin as date) and btd.split <> 'train' group by s.site, o.origin""",
    "start": """select k.kind, p.site, p.origin, d.capacity, d.upstream_site, u.hist[-1] as held, p.hist from past p join site_dim d on d.site = p.site
        left join past u on u.site = d.upstream_site and u.origin = p.origin cross join (values ('cascade'), ('plant')) k(kind)""",
    "roll": f"""select kind, site, origin, capacity, upstream_site, held, hist, 0 as recursive_step, cast(0 as double) as predicted from start
        union all select kind, site, origin, capacity, upstream_site, held, list_append(hist[2:], p), recursive_step + 1, p from (
          select * exclude (p3), least({_cap(f'least(greatest(p3, hist[-1] - {FIXED["ramp"]}), hist[-1] + {FIXED["ramp"]})')}, capacity) as p from (
          select * exclude (p2), {_cap(f'(1 - {FIXED["anchor_weight"]}) * p2 + {FIXED["anchor_weight"]} * ({FIXED["anchor_current"]} * hist[-1] + (1 - {FIXED["anchor_current"]}) * hist[-24])')} as p3 from (
          select * exclude (p1), {_cap(f'(1 - {FIXED["blend_weight"]}) * p1 + {FIXED["blend_weight"]} * hist[-24]')} as p2 from (
          select * exclude (delta), {_cap(f'hist[-1] + {FIXED["shrinkage"]} * delta + {FIXED["bias"]} + {FIXED["hour_scale"]} * (recursive_step - 11.5) / 8')} as p1 from (
          select a.kind, a.site, a.origin, a.capacity, a.upstream_site, a.held, a.hist, a.recursive_step,
            {_w['intercept']} + {_w['target_hour_sin']} * sin(2 * pi() * a.recursive_step / 24) + {_w['current']} * a.hist[-1] + {_w['lag1']} * a.hist[-2] + {_w['lag24']} * a.hist[-25]
            + {_w['rollmean24']} * list_avg(a.hist[-24:]) + {_w['rollmin3']} * list_min(a.hist[-3:]) + {_w['diff1']} * (a.hist[-1] - a.hist[-2])
            + {_w['target_lag24']} * a.hist[-24] + {_w['target_lag168']} * a.hist[-168]
            + {_w['upstream_current']} * coalesce(case when a.kind = 'plant' then a.held else u.hist[-1] end, 0.0) as delta
          from roll a left join roll u on u.kind = a.kind and u.origin = a.origin and u.site = a.upstream_site where a.recursive_step < 24)))))""",
    "rolled": "select kind, site, origin, cast(recursive_step as integer) as h, origin + (recursive_step - 1) * interval 1 hour as ts, capacity, predicted from roll where recursive_step > 0",
}


@REG.add("rollout_linear", f"select kind, site, origin, h, {r6s('predicted')} as predicted from rolled", ROLL)
def rollout_linear(spark, sf):
    """Every step of a linear model with bias, hourly shift, blend, level anchor and ramp; upstream forecasts feed downstream ones."""
    _, out = linear_rollouts(spark, sf)
    return out.select("kind", "site", "origin", "h", r6("predicted").alias("predicted"))


@REG.add("linear_backtests", f"""select kind, site, split, n, {', '.join(f'{r6s(c)} as {c}' for c in ('operational_mape', 'mae', 'rmse', 'r2'))} from (
    select r.kind, r.site, btd.split, count(*) as n, {metric_sql('s.total', 'r.predicted', 'r.capacity')} from rolled r
    join site_series s on s.site = r.site and s.ts = r.ts join btd on btd.d = cast(r.origin as date) group by all)""", ROLL)
def linear_backtests(spark, sf):
    """Rolling scores of the fixed model by split: whole cascades, and sites with their upstream held."""
    b, out = linear_rollouts(spark, sf)
    return rounded(b.scored(out).groupBy("kind", "site", "split").agg(F.count(F.lit(1)).alias("n"), *metric_columns()))


@REG.add("rollout_24h")
def rollout_24h(spark, sf):
    b = Bench(spark, sf, ("testing",))
    model, _ = radial_model(spark, sf, series=b.series)
    out = J.rollout_24h(b.states(J.whole_cascade(b.site_dim), fitted(spark, sf), model), "operational")
    return rounded(J.unit_rows(out).select("site", "unit", "origin", "h", "mw"))


def backtest(spark, sf, plan=None):
    b = Bench(spark, sf)
    model, _ = radial_model(spark, sf, series=b.series)
    chosen = None if plan is None else plan(b)
    return b, J.rollout_24h(b.states(J.whole_cascade(b.site_dim), fitted(spark, sf), model, plan=chosen))


@REG.add("rolling_backtest")
def rolling_backtest(spark, sf):
    b, out = backtest(spark, sf)
    return rounded(b.scored(out).groupBy("site", "split").agg(F.count(F.lit(1)).alias("n"), *metric_columns()))


@REG.add("plant_backtest")
def plant_backtest(spark, sf):
    b = Bench(spark, sf)
    model, _ = radial_model(spark, sf, series=b.series)
    out = J.rollout_24h(b.states(J.single_sites(b.site_dim), fitted(spark, sf), model))
    return rounded(b.scored(out).groupBy("site", "split").agg(F.count(F.lit(1)).alias("n"), *metric_columns()))


@REG.add("outage_informed_backtest")
def outage_informed_backtest(spark, sf):
    same_day = lambda b: I.outage_plan_informed(b.unit_dim, b.units.select("site", "unit", "ts", "available"), b.origins)
    b, out = backtest(spark, sf, same_day)
    scored = b.scored(out).groupBy("site", "split").agg(F.count(F.lit(1)).alias("n"), *metric_columns())
    return rounded(scored.withColumn("scenario", F.lit("outage_informed_sensitivity")))


@REG.add("attach_actuals", """select p.model, p.site, p.ts, p.predicted, s.total as actual from predictions p
    join site_series s on s.site = p.site and s.ts = p.ts where p.split <> 'train'""")
def attach_actuals(spark, sf):
    p = X.predictions(spark, sf).where("split <> 'train'").select("model", "site", "ts", "predicted")
    return J.attach_actuals(p, X.site_series(spark, sf)).select("model", "site", "ts", "predicted", "actual")


ONE = {"cv": QC.CAL["cr"].replace("ts >= d0 + interval 21 day and ts < d0 + interval 25 day", "ts >= d0 + interval 25 day"),
       "c1t": f"select cv.*, {QC.clip_sql('(current + f.shrinkage * delta + f.bias)')} as pred from cv join sfit f on f.site = cv.site"}


@REG.add("one_step_eval", f"""select site, split, n, {', '.join(f'{r6s(c)} as {c}' for c in ('operational_mape', 'mae', 'rmse', 'r2'))} from (
    select site, 'validation' as split, count(*) as n, {metric_sql('actual', 'pred')} from c1 group by site
    union all select site, 'testing', count(*), {metric_sql('actual', 'pred')} from c1t group by site)""", QC.CAL | QC.CHAIN | ONE)
def one_step_eval(spark, sf):
    """One hour ahead on validation and testing rows, calibrated on validation."""
    v = QC.calibration_rows(spark, sf)
    fit = H.fit_shrinkage_bias(v)
    both = v.withColumn("split", F.lit("validation")).unionByName(QC.calibration_rows(spark, sf, "testing").withColumn("split", F.lit("testing")))
    out = H.apply_shrinkage_bias(both, fit)
    return rounded(out.groupBy("site", "split").agg(F.count(F.lit(1)).alias("n"), *metric_columns("actual", "pred")))


@REG.add("tree_backtests")
def tree_backtests(spark, sf):
    """J3 and J4 of both tree families: all sites together, and each with its upstream site held.

    Families and kinds are cascades of their own, so one rollout does all four.
    """
    b = Bench(spark, sf)
    rows = cut_lineage(training(spark, sf, b.series).where("split = 'train'"))
    fits = [T.fit(rows, M.feature_names(), family, [config]) for family, config in (("forest", S.FOREST_CONFIGS[0]), ("boosting", S.BOOSTING_CONFIGS[0]))]
    models = cut_lineage(reduce(DataFrame.unionByName, fits))
    kinds = [m(b.site_dim).withColumn("kind", F.lit(k)) for k, m in (("cascade", J.whole_cascade), ("plant", J.single_sites))]
    members = reduce(DataFrame.unionByName, kinds).withColumn("family", F.explode(F.array(F.lit("forest"), F.lit("boosting"))))
    members = cut_lineage(members.withColumn("cascade", F.concat_ws("|", "kind", "family", "cascade")))
    trees = models.drop("point", "rows").join(members.select("cascade", "site", "family"), ["site", "family"])
    out = J.rollout_24h(b.states(members.drop("kind", "family"), fitted(spark, sf)), trees=trees)
    kind, family = (F.split("cascade", r"\|")[i] for i in (0, 1))
    scored = b.scored(out).groupBy(family.alias("family"), kind.alias("kind"), "site", "split")
    return rounded(scored.agg(F.count(F.lit(1)).alias("n"), *metric_columns()))


@REG.add("select_boosted")
def select_boosted(spark, sf):
    """All search points and shrinkage values of the boosted trees, three finalists by rolling score."""
    b = Bench(spark, sf, ("validation",))
    rows, names = training(spark, sf, b.series), M.feature_names()
    models = cut_lineage(T.fit(rows.where("split = 'train'"), names, "boosting", T.search_points("boosting", b.site_dim)))
    ahead = T.predict(rows.where("split = 'validation'").select("site", "tplus1", *names), models, names)
    ahead = cut_lineage(ahead.join(b.site_dim.select("site", "capacity"), "site").select("site", "point", "current", "delta", F.col("tplus1").alias("actual"), "capacity"))
    make = lambda members, calibration: b.states(members, calibration, keys=("cascade", "site"))
    return rounded(Z.select_models(ahead, models, make, J.single_sites(b.site_dim), b.series, b.site_dim))


@REG.add("select_radial")
def select_radial(spark, sf):
    """All search points and shrinkage values of the radial model, ten finalists by rolling score."""
    b, names = Bench(spark, sf, ("validation",)), M.feature_names()
    rows = training(spark, sf, b.series)
    scaler = cut_lineage(M.fit_scaler(rows.where("split = 'train'"), names))
    scaled = cut_lineage(M.standard_scale(rows, scaler, names))
    points = cut_lineage(M.radial_points(b.site_dim))
    models = cut_lineage(M.radial_search(scaled.where("split = 'train'"), points, len(names)))
    ahead = M.radial_predict_points(scaled.where("split = 'validation'").select("site", "current", "tplus1", "x"), models, points)
    ahead = cut_lineage(ahead.join(b.site_dim.select("site", "capacity"), "site").select("site", "point", "current", "delta", F.col("tplus1").alias("actual"), "capacity"))
    make = lambda members, calibration, own: b.states(members, calibration, own, keys=("cascade", "site"), model_keys=("cascade", "site"))
    best = Z.select_models(ahead, models.join(scaler, "site"), make, J.single_sites(b.site_dim), b.series, b.site_dim, S.FINALISTS_PRIMARY, S.R2_WEIGHT_PRIMARY)
    return rounded(best.join(points, ["site", "point"]))


def selection_inputs(spark, sf):
    b = Bench(spark, sf, ("validation",))
    model, scaled = radial_model(spark, sf, series=b.series)
    # One-step rows of the same model on validation days.
    rows = M.rbf_predict(scaled.where("split = 'validation'"), model).join(b.site_dim.select("site", "capacity"), "site").select(
        "site", "ts", (F.hour(F.col("ts") + F.expr("interval 1 hour")) + 1).alias("target_hour"), "current", "delta",
        F.col("tplus1").alias("actual"), F.col("target_lag24").alias("anchor"), "capacity",
    )
    make = lambda members, calibration: b.states(members, calibration, model, keys=("cascade", "site"))
    return b, cut_lineage(rows), make


@REG.add("two_stage_select")
def two_stage_select(spark, sf):
    b, rows, make = selection_inputs(spark, sf)
    return rounded(Z.two_stage_select(rows, make, J.single_sites(b.site_dim), b.series, b.site_dim))


@REG.add("staged_accept")
def staged_accept(spark, sf):
    b, rows, make = selection_inputs(spark, sf)
    out = Z.staged_accept(rows, make, J.single_sites(b.site_dim), b.series, b.site_dim, QC.train_ramps(spark, sf), bin_rules=QC.bin_rules(spark, sf))
    return rounded(out.select("site", "shrinkage", "bias", *[f"{step}_accepted" for step in Z.STEPS]))
