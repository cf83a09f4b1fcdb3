"""Models of the hourly change, fitted as Spark jobs.

The radial-basis model is fitted per site. Its centers come from Lloyd rounds in
which all sites share one aggregation. Its weights come from normal equations:
every task adds up the Gram matrices of the sites it sees, a bounded number of them
at a time, only those fixed-size sums are shuffled, and one small system per site is
solved. A site with very many rows is therefore spread over all tasks that hold its
rows. Trees over all sites (site as an input) are one MLlib model; trees per site
are in ``trees``.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import constant_array, series_window
from ..session import cut_lineage
from . import features as E

TARGET = "delta_tplus1"


def feature_names() -> list[str]:
    """Inputs shared by training and serving, in model order."""
    roll = E.rolling_names()
    return (
        ["target_hour_sin", "target_hour_cos", "target_day_sin", "target_day_cos", "target_is_weekend", "current"]
        + [f"lag{n}" for n in S.LAGS] + roll + [f"diff{n}" for n in S.DIFFS] + ["target_lag24", "target_lag168"]
        + ["upstream_current"] + [f"upstream_gen_lag{n}" for n in S.LAGS] + ["units_running", "plant_available"]
    )


def model_frame(series: DataFrame, edges: DataFrame) -> DataFrame:
    """All model inputs and the target: one equi-join, then one window pass."""
    ups = series.select(F.col("site").alias("upstream_site"), "ts", F.col("total").alias("upstream_current"))
    own = series.join(edges.select("site", "upstream_site"), "site")
    own = own.join(ups, ["upstream_site", "ts"], "left").withColumn("upstream_current", F.coalesce("upstream_current", F.lit(0.0)))
    w = series_window(["site"])
    rolled = E.rolling_stats(own, ["site"], "total")
    frame = rolled.withColumn("plant_available", F.when(F.col("units_running") > 0, 1).otherwise(0)).select(
        "site", "ts", "total", "units_running", "plant_available", "upstream_current",
        *E.target_calendar(), *E.lead_target("total", w), *E.lags("total", w), *E.rolling_names(),
        *E.diffs("total", w), *E.target_lags("total", w), *E.lags("upstream_current", w, prefix="upstream_gen_lag"),
    )
    return frame.withColumns({n: F.col(n).cast("double") for n in feature_names()})


# --- scaling ---------------------------------------------------------------

def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """(site, mean, std) as arrays; population deviation, constant columns get 1."""
    std = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return train.groupBy("site").agg(
        F.array(*[F.avg(c) for c in columns]).alias("mean"), F.array(*[std(c) for c in columns]).alias("std")
    )


def standard_scale(df: DataFrame, scaler: DataFrame, columns: list[str], out: str = "x") -> DataFrame:
    """Scale into one array column with statistics from training rows only."""
    raw = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    scaled = F.zip_with(F.zip_with(raw, "mean", lambda v, m: v - m), "std", lambda v, s: v / s)
    return df.join(scaler, "site").withColumn(out, scaled).drop("mean", "std")


# --- radial basis ----------------------------------------------------------

def kmeans_centers(scaled: DataFrame, k: int, x: str = "x", seed: int = 42, iterations: int = 10) -> list[list[float]]:
    """``k`` centers; with fewer rows than that, the last one is repeated.

    The centers are the model: k times the number of features, whatever the data size.
    """
    rows = scaled.select(array_to_vector(x).alias("features"))
    n = rows.limit(k).count()
    model = KMeans(k=min(k, n), seed=seed, maxIter=iterations).fit(rows) if n > 1 else None
    found = [list(map(float, c)) for c in model.clusterCenters()] if model else [rows.first()[0].toArray().tolist()]
    return found + [found[-1]] * (k - len(found))


#: Rows of a site that share one copy of its centers in a round.
PACK = 256


def pack_rows(rows: DataFrame, x: str = "x") -> DataFrame:
    """(site, xs): rows put together by site where they lie, without a shuffle; at most ``PACK`` in one."""

    def run(batches):
        for pdf in batches:
            out = []
            for site, part in pdf.groupby("site", sort=False):
                xs = part["x"].tolist()
                out += [(site, xs[a : a + PACK]) for a in range(0, len(xs), PACK)]
            yield pd.DataFrame(out, columns=["site", "xs"])

    return rows.select("site", F.col(x).alias("x")).mapInPandas(run, "site string, xs array<array<double>>")


def _center_sums(batches):
    """(site, i, n, s): rows and sums of the nearest center, added up over the task; a bounded number of sites is held."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out():
        rows = [(k, int(i), int(n[i]), s[i].tolist()) for k, (n, s) in held.items() for i in np.flatnonzero(n)]
        held.clear()
        return pd.DataFrame(rows, columns=["site", "i", "n", "s"])

    for pdf in batches:
        for site, xs, cs in zip(pdf["site"], pdf["xs"], pdf["centers"], strict=True):
            if site not in held and len(held) >= SITES_HELD:
                yield out()
            v, c = np.vstack(list(xs)), np.vstack(list(cs))
            n, s = held.setdefault(site, (np.zeros(len(c), dtype=np.int64), np.zeros(c.shape)))
            # Differences, not products: equal distances stay equal, so the first center wins a tie.
            step = max(1, 2_000_000 // c.size)
            for a in range(0, len(v), step):
                part = v[a : a + step]
                near = ((part[:, None, :] - c[None]) ** 2).sum(-1).argmin(1)
                np.add.at(n, near, 1)
                np.add.at(s, near, part)
    if held:
        yield out()


def lloyd_round(rows: DataFrame, centers: DataFrame, x: str = "x") -> DataFrame:
    """(site, centers, moved): one round of all sites in one aggregation.

    Every row goes to the nearest center of its site, the first on a tie; sums by
    (site, center) are added up in the tasks that read the rows. A center without rows
    stays. ``moved`` is the largest squared step of a site's centers. ``rows`` may be
    packed already (:func:`pack_rows`).
    """
    packed = rows if "xs" in rows.columns else pack_rows(rows, x)
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    size = F.size(F.get("centers", F.lit(0)))
    sums = packed.join(centers.select("site", "centers"), "site").select("site", "xs", "centers").mapInPandas(_center_sums, "site string, i int, n long, s array<double>")
    tall = sums.select("site", "i", "n", F.posexplode("s").alias("j", "v"))
    means = tall.groupBy("site", "i", "j").agg((F.sum("v") / F.sum("n")).alias("m"))
    new = means.groupBy("site", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "m"))), lambda r: r["m"]).alias("c"))
    new = new.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("new"))
    both = centers.select("site", "centers").join(new, "site", "left")
    moved = F.transform("centers", lambda c, i: F.coalesce(F.try_element_at("new", i), c))
    step = F.array_max(F.zip_with("centers", "next", gap))
    return both.withColumn("next", moved).select("site", F.col("next").alias("centers"), F.when(size > 0, step).otherwise(0.0).alias("moved"))


def site_centers(scaled: DataFrame, k: int | str, x: str = "x", seed: int = 42, rounds: int = 300, tolerance: float = 1e-4) -> DataFrame:
    """(site, centers): ``k`` centers per site, the last repeated where a site has fewer rows.

    ``k`` is a number, or the column that has each site's. Seeded by rows of smallest
    hash; stops when no center of any site moves by more than ``tolerance`` (squared).
    Each round's centers are written, k times the number of inputs a site.
    """
    many = F.lit(k) if isinstance(k, int) else F.col(k)
    order = Window.partitionBy("site").orderBy(F.xxhash64(F.lit(seed), x), x)
    first = scaled.select("site", x, many.alias("_k")).distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("_k"))
    found = first.groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", x))), lambda r: r[x]).alias("c"), F.first("_k").alias("_k"))
    padded = F.concat("c", F.array_repeat(F.element_at("c", -1), F.col("_k") - F.size("c")))
    centers = cut_lineage(found.select("site", padded.alias("centers")))
    packed = cut_lineage(pack_rows(scaled, x))
    for _ in range(rounds):
        centers = cut_lineage(lloyd_round(packed, centers, x))
        if centers.where(F.col("moved") > tolerance).isEmpty():
            break
    return centers.select("site", "centers")


def rbf_expand(x, centers: Column, gamma: Column) -> Column:
    """exp(-gamma_i * |x - c_i|^2) for arrays of centers and widths."""
    x = F.col(x) if isinstance(x, str) else x
    gap = lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return F.zip_with(centers, gamma, lambda c, g: F.exp(-g * gap(c)))


def _phi(x: np.ndarray, centers: np.ndarray, gamma: float) -> np.ndarray:
    """Design matrix: constant, and radial units (or the inputs without centers)."""
    if centers.size:
        d2 = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None, :]
        x = np.exp(-gamma * np.maximum(d2, 0.0))
    return np.hstack([np.ones((len(x), 1)), x])


#: Gram matrices a task holds before it hands them on.
SITES_HELD = 64


def rbf_regression(
    scaled: DataFrame, centers: list[list[float]] | DataFrame, gamma: float, ridge: float = 1.0, x: str = "x", y: str = TARGET, held: int | None = None,
) -> DataFrame:
    """(site, coef, centers, gamma, rows): ridge weights per site.

    ``centers`` are shared by all sites or a table of :func:`site_centers`. At most
    ``held`` matrices are in a task's memory while rows are added up, and one when
    the parts of a site, ordered, are put together.
    """
    own, most = isinstance(centers, DataFrame), held or SITES_HELD
    if own:
        wide = F.transform("centers", lambda _: F.lit(float(gamma)))
        scaled = scaled.drop("centers").join(centers, "site").withColumn(x, rbf_expand(x, F.col("centers"), wide))
    c = np.asarray([] if own else centers, dtype=float)

    def partial(batches):
        sums: dict[str, list] = {}

        def out():
            return pd.DataFrame([(k, g.ravel().tolist(), b.tolist(), n) for k, (g, b, n) in sums.items()], columns=["site", "gram", "xty", "n"])

        for pdf in batches:
            for site, part in pdf.groupby("site", sort=False):
                if site not in sums and len(sums) >= most:
                    yield out()
                    sums.clear()
                p = _phi(np.vstack(part["x"].to_numpy()).astype(float), c, gamma)
                t = part["y"].to_numpy(dtype=float)
                s = sums.setdefault(site, [0.0, 0.0, 0])
                s[0], s[1], s[2] = s[0] + p.T @ p, s[1] + p.T @ t, s[2] + len(t)
        if sums:
            yield out()

    def solve(batches):
        site, gram, xty, n = None, 0.0, 0.0, 0

        def out():
            penalty = ridge * np.eye(len(xty))
            penalty[0, 0] = 1e-9
            coef = np.linalg.solve(gram.reshape(len(xty), len(xty)) + penalty, xty)
            return pd.DataFrame({"site": [site], "coef": [coef.tolist()], "rows": [n]})

        for pdf in batches:
            for s, g, b, m in zip(pdf["site"], pdf["gram"], pdf["xty"], pdf["n"], strict=True):
                if s != site:
                    if site is not None:
                        yield out()
                    site, gram, xty, n = s, 0.0, 0.0, 0
                gram, xty, n = gram + np.asarray(g), xty + np.asarray(b), n + int(m)
        if site is not None:
            yield out()

    sums = scaled.select("site", F.col(x).alias("x"), F.col(y).alias("y")).dropna().mapInPandas(
        partial, "site string, gram array<double>, xty array<double>, n long"
    )
    fit = sums.repartition("site").sortWithinPartitions("site").mapInPandas(solve, "site string, coef array<double>, rows long")
    if own:
        return fit.join(centers.select("site", F.flatten("centers").alias("centers")), "site").withColumn("gamma", F.lit(float(gamma)))
    return fit.withColumn("centers", constant_array(c.ravel().tolist())).withColumn("gamma", F.lit(float(gamma)))


def rbf_predict(scaled: DataFrame, model: DataFrame, centers: list[list[float]] | None = None, x: str = "x") -> DataFrame:
    """``delta`` from per-site weights, JVM-side; without ``centers`` each site has those of its model."""
    if centers is None:
        units = F.size("coef") - 1
        width = F.try_divide(F.size("centers"), units).cast("int")
        cs = F.transform(F.sequence(F.lit(0), units - 1), lambda i: F.slice("centers", i * width + 1, width))
        scaled, model = scaled.drop("centers"), model.select("site", "coef", "gamma", "centers")
    else:
        cs, model = constant_array(centers), model.select("site", "coef", "gamma")
    phi = rbf_expand(x, cs, F.transform(cs, lambda _: F.col("gamma")))
    dot = F.aggregate(
        F.zip_with(phi, F.slice("coef", F.lit(2), F.size("coef") - 1), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    )
    out = scaled.join(model, "site").withColumn("delta", F.get("coef", F.lit(0)) + dot).drop("coef", "gamma")
    return out.drop("centers") if centers is None else out


def radial_points(site_dim: DataFrame) -> DataFrame:
    """(site, point, n_centers, gamma): the search points that give models of their own.

    Step size, batch and patience steer an iterative fit; the ridge fit has none of
    them, so points that differ in nothing else are one.
    """
    found = config_grid(site_dim).select("site", "n_centers", "gamma").distinct()
    return found.withColumn("point", F.row_number().over(Window.partitionBy("site").orderBy("n_centers", "gamma")))


def radial_search(train: DataFrame, points: DataFrame, width: int, ridge: float = 1.0, x: str = "x") -> DataFrame:
    """(site, point, coef, centers, gamma, rows) for every search point of every site.

    Centers do not depend on the width of a unit, so each (site, number of centers) is
    one key of shared Lloyd rounds, whatever the number of points with it. ``gamma`` is
    stated per input: it is divided by ``width``, the number of inputs. Rows are copied
    once per number of centers in the join that feeds a task's sums, never written.
    """
    key = F.concat_ws("|", "site", "n_centers")
    plain = train.select("site", x, TARGET)
    sizes = points.select("site", "n_centers").distinct()
    centers = site_centers(plain.join(sizes, "site").select(key.alias("site"), x, "n_centers"), "n_centers", x)
    centers = cut_lineage(centers.select(F.regexp_extract("site", r"^(.*)\|", 1).alias("site"), F.regexp_extract("site", r"\|(\d+)$", 1).cast("int").alias("n_centers"), "centers"))
    place = F.concat_ws("|", "site", "point")
    fits = []
    for g in sorted(r["gamma"] for r in points.select("gamma").distinct().collect()):
        at = points.where(F.col("gamma") == g)
        mine = at.join(centers, ["site", "n_centers"]).select(place.alias("site"), "centers")
        rows = plain.join(at.select("site", "point"), "site").select(place.alias("site"), x, TARGET)
        fits.append(rbf_regression(rows, mine, gamma=g / width, ridge=ridge, x=x))
    found = reduce(DataFrame.unionByName, fits)
    return found.select(
        F.regexp_extract("site", r"^(.*)\|", 1).alias("site"), F.regexp_extract("site", r"\|(\d+)$", 1).cast("int").alias("point"), "coef", "centers", "gamma", "rows"
    )


def radial_predict_points(scaled: DataFrame, models: DataFrame, points: DataFrame) -> DataFrame:
    """``scaled`` once per search point of its site, with ``point`` and ``delta``."""
    place = F.concat_ws("|", "site", "point")
    rows = scaled.join(points.select("site", "point"), "site").withColumn("_site", F.col("site")).withColumn("site", place)
    out = rbf_predict(rows, models.withColumn("site", place))
    return out.withColumn("site", F.col("_site")).drop("_site")


# --- trees -----------------------------------------------------------------

def _tree_inputs(columns: list[str]) -> list:
    """Sites as indicator columns, so any number of them fits; a missing input is 0, as for the radial model."""
    filled = ", ".join(f"coalesce(cast(`{c}` as double), 0D) as `_f{i}`" for i, c in enumerate(columns))
    return [
        StringIndexer(inputCol="site", outputCol="_site", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol="_site", outputCol="_site_is", handleInvalid="keep", dropLast=False),
        SQLTransformer(statement=f"select *, {filled} from __THIS__"),
        VectorAssembler(inputCols=["_site_is", *[f"_f{i}" for i in range(len(columns))]], outputCol="features", handleInvalid="keep"),
    ]


def random_forest(train: DataFrame, columns: list[str], config=S.FOREST_CONFIGS[0], seed: int = 42) -> PipelineModel:
    trees, depth, leaf, share = config
    rf = RandomForestRegressor(
        labelCol=TARGET, numTrees=trees, maxDepth=depth or 30, minInstancesPerNode=leaf, featureSubsetStrategy=share, seed=seed,
    )
    return Pipeline(stages=[*_tree_inputs(columns), rf]).fit(train)


def boosted_trees(train: DataFrame, columns: list[str], config=S.BOOSTING_CONFIGS[0], seed: int = 42) -> PipelineModel:
    """Squared-error boosting; there is no L2 term in MLlib, so that value is unused."""
    rounds, rate, depth, rows, cols, _ = config
    gbt = GBTRegressor(
        labelCol=TARGET, maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=rows, featureSubsetStrategy=str(cols), seed=seed,
    )
    return Pipeline(stages=[*_tree_inputs(columns), gbt]).fit(train)


def predict_delta(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).select(*df.columns, F.col("prediction").alias("delta"))


# --- store and search space ------------------------------------------------

def save_model(model: PipelineModel, path: str, name: str, columns: list[str], calibration: dict | None = None) -> None:
    """Model plus one metadata row: ordered features and calibration."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    meta = spark.createDataFrame([(name, columns, json.dumps(calibration or {}))], "model string, features array<string>, calibration string")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_model(path: str, columns: list[str], retrain=None) -> tuple[PipelineModel, DataFrame, bool]:
    """Reload a model; call ``retrain`` when its feature set differs from ``columns``."""
    spark = SparkSession.active()
    meta = spark.read.parquet(f"{path}/meta")
    same = set(meta.first()["features"]) == set(columns)
    if same or retrain is None:
        return PipelineModel.load(f"{path}/model"), meta, False
    return retrain(), meta, True


def config_grid(site_dim: DataFrame) -> DataFrame:
    """Search points per site: shared ones and those of its place in the cascade."""
    kind = "array<struct<n_centers:int,learning_rate:double,gamma:double,batch_size:int,patience:int>>"
    pack = lambda rows: F.array(*[F.struct(*[F.lit(v) for v in r]) for r in rows]).cast(kind)
    extra = F.create_map(*[x for k, rows in S.RBF_EXTRA_CONFIGS.items() for x in (F.lit(k), pack(rows))])
    own = F.coalesce(F.try_element_at(extra, F.col("ordinal")), F.array().cast(kind))
    return site_dim.select("site", F.explode(F.concat(pack(S.RBF_BASE_CONFIGS), own)).alias("c")).select("site", "c.*").dropDuplicates()
