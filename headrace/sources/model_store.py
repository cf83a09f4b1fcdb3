"""A versioned table of models: weights, centers, trees, inputs and calibration.

``<path>/models/version=V`` holds the rows of a version, one per (family, site, point);
``<path>/versions`` one manifest row per version, written after its rows. The newest
manifest row makes its version current, so a save that dies half-way leaves the
version before it in force, and readers never see rows of two versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollout import NO_CALIBRATION, NO_MODEL
from ..operators.trees import MODEL

KEYS = ("family", "site", "point")
_TREES = dict(c.rsplit(" ", 1) for c in MODEL.split(", "))
#: Columns of every family; those that a family does not have are NULL.
COLUMNS = {**_TREES, **NO_MODEL, **NO_CALIBRATION, "saved_blend": "double"}
MANIFEST = "seq long, version string, features array<string>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def current_version(spark: SparkSession, path: str) -> tuple[int, str, list[str]] | None:
    """(number, version, ordered inputs) of the version in force; None without any."""
    if not _exists(spark, f"{path}/versions"):
        return None
    last = spark.read.schema(MANIFEST).parquet(f"{path}/versions").agg(F.max(F.struct("seq", "version", "features")).alias("m")).first()["m"]
    return None if last is None else (last["seq"], last["version"], list(last["features"]))


def _rows(df: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of the store; a family of one model per site has point 1."""
    have = {c: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in COLUMNS.items()}
    have["point"] = F.coalesce(have["point"], F.lit(1))
    return df.select(*[v.alias(c) for c, v in have.items()])


def save_models(models: DataFrame, features: list[str], path: str, calibration: DataFrame | None = None) -> str:
    """Write a new version: ``models`` and, if it has the same inputs, every other model of the version in force.

    ``models`` has ``family, site`` and the columns of its family; ``calibration`` is
    joined by site (and by family, if it has that column). Models of other inputs
    cannot be served beside these, so they are left behind in their own version.
    """
    spark = models.sparkSession
    last = current_version(spark, path)
    if calibration is not None:
        by = [c for c in ("family", "site") if c in calibration.columns]
        fields = [c for c in (*NO_CALIBRATION, "saved_blend") if c in calibration.columns]
        models = models.drop(*fields).join(calibration.select(*by, *fields), by, "left")
    version = uuid.uuid4().hex
    new = _rows(models)
    new.write.parquet(f"{path}/models/version={version}")
    if last and last[2] == list(features):
        written = spark.read.schema(new.schema).parquet(f"{path}/models/version={version}")
        old = spark.read.schema(new.schema).parquet(f"{path}/models/version={last[1]}")
        kept = old.join(written.select(*KEYS[:2]).distinct(), list(KEYS[:2]), "left_anti")
        kept.write.mode("append").parquet(f"{path}/models/version={version}")
    seq = last[0] + 1 if last else 1
    spark.createDataFrame([(seq, version, list(features))], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def load_models(
    spark: SparkSession, path: str, features: list[str], retrain: Callable[[], DataFrame] | None = None, version: str | None = None,
) -> tuple[DataFrame, list[str], bool]:
    """(models, their ordered inputs, retrained) of the version in force, or of ``version``.

    A store whose inputs differ from ``features`` as a set, or that has no version,
    is trained anew by ``retrain`` and saved; without ``retrain`` that is an error.
    """
    last = current_version(spark, path)
    if last is None or set(last[2]) != set(features):
        if retrain is None:
            raise ValueError(f"the models in {path} were trained on other inputs" if last else f"no models in {path}")
        save_models(retrain(), features, path)
        return load_models(spark, path, features)[0], list(features), True
    kinds = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    return spark.read.schema(kinds).parquet(f"{path}/models/version={version or last[1]}"), last[2], False


def family(models: DataFrame, name: str) -> DataFrame:
    """The models of one family, with the columns that predicting needs."""
    kept = models.where(F.col("family") == name)
    return kept.select(*_TREES) if name in ("forest", "boosting") else kept.select("family", "site", "point", *NO_MODEL, "rows")


def with_saved_blend(calibration: DataFrame, tuned: DataFrame, model: str) -> DataFrame:
    """``saved_blend`` from tuned weights of stored predictions (model, site, weight, adopted); only adopted ones count."""
    own = tuned.where((F.col("model") == model) & F.col("adopted")).select("site", F.col("weight").alias("saved_blend"))
    return calibration.drop("saved_blend").join(own, "site", "left")


def serving_calibration(models: DataFrame, name: str) -> DataFrame:
    """Calibration by site as a rollout takes it: a stored blend overrides the fitted one."""
    blend = F.coalesce("saved_blend", "blend_weight").alias("blend_weight")
    rest = [c for c in NO_CALIBRATION if c != "blend_weight"]
    return models.where(F.col("family") == name).select("site", *rest, blend)
