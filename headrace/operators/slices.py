"""Filters and point-in-time slices relative to forecast origins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import operational_threshold


def day_of(ts="ts"):
    return F.to_date(ts)


def history_before(df: DataFrame, origin, ts: str = "ts") -> DataFrame:
    """Rows strictly before one origin (a column or literal timestamp)."""
    return df.where(F.col(ts) < origin)


def known_from(df: DataFrame, origins: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows before any origin, each with ``known_from``, the first origin day after it.

    The history of an origin is the rows with ``known_from <= origin``, so one copy of
    the rows serves all origins. The day's origin is found once per day and joined back.
    """
    days = df.select(day_of(ts).alias("_d")).distinct().withColumn("_all", _origin_days(origins))
    first = F.array_min(F.filter("_all", lambda o: o > F.col("_d")))
    found = days.select("_d", first.cast("timestamp_ntz").alias("known_from")).where("known_from is not null")
    return df.withColumn("_d", day_of(ts)).join(found, "_d").drop("_d")


def _origin_days(origins: DataFrame):
    """The origin days as one array, for expressions; one place per day."""
    return origins.agg(F.collect_set(F.to_date("origin")).alias("o")).select("o").scalar()


def history_by_origin(df: DataFrame, keys: list[str], value: str, origins: DataFrame, ts: str = "ts") -> DataFrame:
    """Size, span, sum and newest value of the history before every origin.

    Each row is added up once, under the first origin that knows it; running sums
    over a series' origins give the histories, and an origin without new rows repeats
    the one before. Sums are decimal, hence exact. Origins without history are left out.
    """
    money = F.sum(F.col(value).cast("decimal(18,6)"))
    parts = known_from(df, origins, ts).groupBy(*keys, "known_from").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), money.alias("s"), F.max_by(value, ts).alias("newest")
    )
    w = Window.partitionBy(*keys).orderBy("known_from")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    until = F.to_date(F.lead("known_from").over(w))
    return parts.select(
        *keys, F.sum("n").over(so_far).alias("n"), F.min("first_ts").over(so_far).alias("first_ts"), "last_ts", "newest",
        F.sum("s").over(so_far).cast("double").alias("total"), F.to_date("known_from").alias("_from"), until.alias("_until"),
    ).withColumn("_all", _origin_days(origins)).select(
        *keys, F.explode(F.filter("_all", lambda o: (o >= F.col("_from")) & (F.col("_until").isNull() | (o < F.col("_until"))))).alias("_o"),
        "n", "first_ts", "last_ts", "newest", "total",
    ).select(*keys, F.col("_o").cast("timestamp_ntz").alias("origin"), "n", "first_ts", "last_ts", "newest", "total")


def actual_day(df: DataFrame, origins: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of each origin day: an equi-join on the date."""
    days = origins.select(F.to_date("origin").alias("_d"), "origin")
    return df.withColumn("_d", day_of(ts)).join(days, "_d").drop("_d")


def at_hour(cells, h):
    """The cell of hour ``h`` in an array of cells with a field ``h``; NULL where the day lacks it."""
    return F.get(F.filter(cells, lambda c: c["h"] == h), F.lit(0))


def daily_arrays(df: DataFrame, keys: list[str], value: str, ts: str = "ts", name: str = "hours", by_hour: str | None = None) -> DataFrame:
    """One row per series and day with the values present, in hour order (24 at most).

    ``by_hour`` names a second array with exactly 24 places, NULL where an hour is absent.
    """
    cells = F.sort_array(F.collect_list(F.struct(F.hour(ts).alias("h"), F.col(value).alias("v"))))
    daily = df.groupBy(*keys, day_of(ts).alias("d")).agg(cells.alias("_c"))
    full = [] if by_hour is None else [F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: at_hour(F.col("_c"), h)["v"]).alias(by_hour)]
    return daily.select(*keys, "d", F.transform("_c", lambda c: c["v"]).alias(name), *full)


def with_origin_days(daily: DataFrame, keys: list[str], origins: DataFrame) -> DataFrame:
    """``daily`` with an empty row for each series and origin day that has none yet.

    A forecast for the day after the last row starts from such a day. The
    origins are few and travel as one array per series.
    """
    days = origins.agg(F.collect_set(F.to_date("origin")).alias("o")).select("o").scalar()
    wanted = daily.select(*keys).distinct().select(*keys, F.explode(days).alias("d")).join(daily.select(*keys, "d"), [*keys, "d"], "left_anti")
    return daily.unionByName(wanted.withColumns({c: F.array().cast(t) for c, t in daily.dtypes if t.startswith("array")}))


def trailing_days(daily: DataFrame, keys: list[str], name: str, days: int, alias: str) -> DataFrame:
    """Attach the previous ``days`` day-arrays, flattened, oldest first.

    The history travels as one array per origin day instead of one copied row
    per (origin, hour); rows are 24 times fewer and each hour is shuffled once.
    """
    w = Window.partitionBy(*keys).orderBy("d").rowsBetween(-days, -1)
    return daily.withColumn(alias, F.flatten(F.collect_list(name).over(w)))


def bounded_history(df: DataFrame, keys: list[str], value: str, ts: str = "ts", hours: int = S.HISTORY_HOURS) -> DataFrame:
    """Per series and origin day, the last ``hours`` values before the day."""
    days = -(-hours // 24)
    daily = trailing_days(daily_arrays(df, keys, value, ts), keys, "hours", days, "history")
    return daily.select(
        *keys, F.col("d").cast("timestamp_ntz").alias("origin"),
        F.slice("history", F.greatest(F.size("history") - hours + 1, F.lit(1)), F.lit(hours)).alias("history"),
    ).where(F.size("history") > 0)


def last_known(df: DataFrame, keys: list[str], value: str, origins: DataFrame, ts: str = "ts") -> DataFrame:
    """As-of join: the latest row strictly before each origin day.

    Each day keeps its last row (map-side combined ``max_by``), which then serves
    the days up to the next one with rows; no row is paired with every origin.
    Origins without any earlier row are dropped.
    """
    last = df.groupBy(*keys, day_of(ts).alias("d")).agg(
        F.max_by(F.struct(F.col(value).alias("v"), F.col(ts).alias("t")), ts).alias("_last")
    )
    days = origins.select(F.to_date("origin").alias("o")).distinct()
    final = days.agg(F.max("o").alias("m")).select("m").scalar()
    # A day's last row serves every origin in (day, next day with rows].
    until = F.coalesce(F.lead("d").over(Window.partitionBy(*keys).orderBy("d")), final)
    return (
        last.withColumn("_until", until)
        .where("_until > d")
        .withColumn("o", F.explode(F.sequence(F.date_add("d", 1), "_until", F.expr("interval 1 day"))))
        .join(days, "o", "left_semi")
        .select(
            *keys,
            F.col("o").cast("timestamp_ntz").alias("origin"),
            F.col("_last.t").alias(f"{ts}_known"),
            F.col("_last.v").alias(value),
        )
    )


def assert_before_origin(df: DataFrame, ts: str, origin: str = "origin") -> DataFrame:
    """Fail the job when a history row is not strictly before its origin."""
    leak = F.raise_error(F.lit("history includes rows at or after the forecast origin"))
    return df.withColumn(ts, F.when(F.col(ts) < F.col(origin), F.col(ts)).otherwise(leak.cast("timestamp_ntz")))


def value_at_lag(value: str, lag: int, w, default: float = 0.0):
    """Value ``lag`` rows back, or the default where it is missing."""
    return F.coalesce(F.lag(value, lag).over(w), F.lit(default))


def operational_filter(df: DataFrame, actual: str = "actual", capacity: str = "capacity") -> DataFrame:
    return df.where(F.abs(F.col(actual)) >= operational_threshold(capacity))


def filter_predictions(df: DataFrame, site: str | None = None, model: str | None = None) -> DataFrame:
    if site is not None:
        df = df.where(F.col("site") == site)
    return df if model is None else df.where(F.col("model") == model)


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)
