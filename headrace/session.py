"""Session settings shared by tests, the bench and the registered queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "headrace", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings that results or plans rely on; cluster sizing is left alone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # HotSpot never compiles methods above 8000 bytecodes; beyond that, split
    # expressions run several times faster than one interpreted huge method.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Rollout states are wide rows: bound Arrow batches by size, not only by count.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    A temporary folder is used only where that setting is missing and the
    master is local, as in tests.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="headrace-"))
    return shared


_LOCAL: dict[str, str] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Several consumers then share one evaluation, a lost executor costs nothing
    but a re-read, and the optimizer sees the real size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
