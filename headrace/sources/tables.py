"""Readers and writers of readings, panels, plans and forecasts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import naming as N
from ..session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared one (local: temporary)."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in (found or []))


def resolve_input(spark: SparkSession, configured: str | None, pattern: str) -> str:
    """The configured path if it exists, else the first match in name order."""
    if configured and _glob(spark, configured):
        return configured
    found = [p for p in _glob(spark, pattern) if not p.rsplit("/", 1)[-1].startswith("~$")]
    if not found:
        raise FileNotFoundError(f"neither {configured} nor {pattern} matches a file")
    return found[0]


def read_any(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.csv(path, header=True) if path.endswith(".csv") else reader.parquet(path)


def load_readings(spark: SparkSession, configured: str | None, pattern: str, schema=None) -> DataFrame:
    return read_any(spark, resolve_input(spark, configured, pattern), schema)


def load_panel(spark: SparkSession, folder: str, name: str = "panel", schema=None) -> DataFrame:
    """The cleaned panel: parquet preferred, CSV as fallback; timestamp rebuilt."""
    path = f"{folder}/{name}.parquet"
    df = read_any(spark, path if _glob(spark, path) else f"{folder}/{name}.csv", schema)
    return df.withColumn("ts", N.build_timestamp(F.col("date").cast("string"), "time"))


def prepare_panel(df: DataFrame) -> DataFrame:
    """ISO date and hour 1..24 instead of the internal timestamp."""
    return df.select(
        *[c for c in df.columns if c != "ts"], F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("date"),
        (F.hour("ts") + 1).alias("time"), F.date_format(F.to_date("ts"), "yyyy-MM").alias("month"),
    )


def write_panel(df: DataFrame, path: str) -> None:
    """Parquet by month; ``rebalance`` splits a heavy month over several files."""
    prepare_panel(df).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)


def write_forecast(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Display columns only: title case with units, hour as a label.

    Hours of a day are in order in one file; days are dealt out, with a folder for each value of ``by``.
    """
    technical = {"ts", "forecast_hour", "model_version", "ordinal", *by}
    shown = {c: "_".join(w.capitalize() for w in c.split("_")) + ("_MW" if re.search("gen|cascade", c) else "") for c in df.columns if c not in technical}
    out = df.withColumn("_d", F.to_date("ts")).repartition(*by, "_d").sortWithinPartitions(*by, "ts").select(
        *by, F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("Date"), N.hour_label(F.hour("ts") + 1).alias("Hour"),
        *[F.col(c).alias(n) for c, n in shown.items()],
    )
    out.write.mode("overwrite").partitionBy(*by).csv(path, header=True)


def load_outage_plan(raw: DataFrame) -> DataFrame:
    """Wide plan -> (site, unit, ts, available); empty or unreadable status means available."""
    names = {c: c.strip() for c in raw.columns}
    low = {n.lower(): c for c, n in names.items()}
    missing = [c for c in ("date", "hour") if c not in low]
    if missing:
        raise ValueError(f"outage plan is missing required columns: {missing}")
    status = {c: n for c, n in names.items() if re.fullmatch(r"out_\w+_unit\d+", n)}
    base = raw.select(
        F.col(f"`{low['date']}`").cast("string").alias("date"),
        N.parse_hour_label(F.col(f"`{low['hour']}`").cast("string")).alias("hour"),
        *[F.when(F.coalesce(N.coerce_numeric(F.col(f"`{c}`")), F.lit(1.0)) > 0, 1).otherwise(0).alias(n) for c, n in status.items()],
    )
    tall = base.unpivot(["date", "hour"], list(status.values()), "name", "available")
    return tall.select(
        F.regexp_extract("name", r"^out_(\w+)_(unit\d+)$", 1).alias("site"),
        F.regexp_extract("name", r"^out_(\w+)_(unit\d+)$", 2).alias("unit"),
        N.build_timestamp("date", "hour").alias("ts"), "available",
    )


def plan_status(c):
    """Edited status -> 0/1: unreadable is 1, clipped, half rounds to even."""
    x = F.least(F.greatest(F.coalesce(N.coerce_numeric(c), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return F.bround(x, 0).cast("int")


def save_outage_plan(df: DataFrame, path: str, columns: list[str]) -> None:
    df.withColumns({c: plan_status(c) for c in columns}).write.mode("overwrite").parquet(path)


def load_actuals(raw: DataFrame, keys: list[str], hour: str, values: list[str], order: str) -> DataFrame:
    """First 24 valid rows per day sheet, numbers coerced, hours 1..24 only."""
    h = N.coerce_numeric(hour).cast("int")
    ok = raw.withColumn("hour", h).where(F.col("hour").between(1, 24))
    w = Window.partitionBy(*keys).orderBy(order)
    return ok.withColumn("_i", F.row_number().over(w)).where("_i <= 24").select(
        *keys, "hour", *[N.coerce_numeric(v).alias(v) for v in values], order
    )
