"""Forests and boosted trees per site, as flat arrays that Spark stores and joins.

Sites and search points are fitted side by side: a site's rows, one per hour and so
bounded, meet in one task that grows the trees of a search point. (A Spark job per level
of a tree would be three thousand jobs in sequence for 720 rounds of depth four.)
"""

from __future__ import annotations

import ast
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import tree_kernel as K
from .models import TARGET

_ARRAYS = "feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, roots array<int>"
MODEL = f"site string, family string, point int, base double, rows long, {_ARRAYS}"
_TYPES = {"threshold": float, "value": float}


def search_points(family: str, site_dim: DataFrame) -> DataFrame:
    """(site, point, config as text) of a family: shared points and those of a site's place in the cascade."""
    shared, extra = (S.FOREST_CONFIGS, S.FOREST_EXTRA_CONFIGS) if family == "forest" else (S.BOOSTING_CONFIGS, {})
    of = lambda rows, start: F.array(*[F.struct(F.lit(start + i + 1).alias("point"), F.lit(repr(c)).alias("config")) for i, c in enumerate(rows)])
    points = of(shared, 0)
    for place, rows in extra.items():
        points = F.when(F.col("ordinal") == place, F.concat(of(shared, 0), of(rows, len(shared)))).otherwise(points)
    return site_dim.select("site", F.explode(points).alias("p")).select("site", "p.*")


def _inputs(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """A missing input is 0, as for the other models."""
    return np.nan_to_num(pdf[columns].to_numpy(dtype=float), nan=0.0)


def fit(train: DataFrame, columns: list[str], family: str, points, y: str = TARGET, seed: int = 42) -> DataFrame:
    """One row per (site, point): the trees as arrays.

    ``points`` is a list of search points for all sites, or a table of
    :func:`search_points`. Rows without a target teach nothing; the same rows give
    the same trees wherever they are fitted.
    """
    grower = K.FAMILIES[family]
    kept = train.select("site", *[F.col(c).cast("double").alias(c) for c in columns], F.col(y).cast("double").alias("_y")).where("_y is not null")

    if isinstance(points, DataFrame):
        each = kept.join(points.select("site", "point", "config"), "site")
    else:
        each = kept.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.lit(repr(c)).alias("config")) for i, c in enumerate(points, 1)])))
        each = each.select(*kept.columns, "_p.*")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        site, point, config = pdf[["site", "point", "config"]].iloc[0]
        pdf = pdf.sort_values([*columns, "_y"], kind="stable")
        rng = np.random.default_rng([seed, int(point), zlib.crc32(site.encode())])
        base, trees = grower(_inputs(pdf, columns), pdf["_y"].to_numpy(), ast.literal_eval(config), rng)
        arrays = [trees[k].astype(_TYPES.get(k, np.int32)).tolist() for k in K.ARRAYS]
        return pd.DataFrame([(site, family, point, base, len(pdf), *arrays)], columns=["site", "family", "point", "base", "rows", *K.ARRAYS])

    # Bound by arithmetic, not bytes: a fixed number keeps small fits from being merged into one task.
    n = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(n, "site", "point").groupBy("site", "point").applyInPandas(one, MODEL)


def predict(rows: DataFrame, model: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``family``, ``point`` and ``delta``, once per model of their site."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, m in right.iterrows() if len(left) else ():
            delta = m["base"] + K.leaves(_inputs(left, columns), K.arrays_of(m))
            parts.append(left.assign(family=m["family"], point=m["point"], delta=delta))
        return pd.concat(parts) if parts else left.iloc[:0].assign(family="", point=0, delta=0.0)

    schema = ", ".join([*[f"`{n}` {t}" for n, t in rows.dtypes], "family string", "point int", "delta double"])
    return rows.groupBy("site").cogroup(model.groupBy("site")).applyInPandas(run, schema)


def nodes(model: DataFrame) -> DataFrame:
    """The trees as a table: one row per node, for SQL and for reading."""
    each = F.posexplode(F.arrays_zip("feature", "threshold", "left", "right", "value"))
    flat = model.select("site", "family", "point", "base", "roots", each.alias("node", "x"))
    return flat.select("site", "family", "point", "base", "node", F.array_contains("roots", F.col("node")).alias("is_root"), "x.*")
