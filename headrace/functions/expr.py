"""Column expressions used by several operator families."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..session import cut_lineage

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Six decimals, with negative zero folded into zero.

    Averages of two-decimal readings often end exactly half-way; the nudge
    settles those the same way whatever order the sum was taken in.
    """
    return F.round(col(c) + F.lit(1e-9), 6) + F.lit(0.0)


def hour_floor(ts) -> Column:
    """Start of the hour as TIMESTAMP_NTZ, independent of the session zone."""
    ts = col(ts)
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def hour_index(ts) -> Column:
    """Hours since 1970-01-01: the row position on a complete hourly grid."""
    ts = col(ts)
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)


def add_hours(ts, n) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return col(ts) + F.make_dt_interval(F.lit(0), n)


def clip(c, lo, hi) -> Column:
    """Clip that keeps NULL (least/greatest alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def cap_clip(c, capacity) -> Column:
    return clip(c, F.lit(0.0), col(capacity) * S.CAPACITY_HEADROOM)


def operational_threshold(capacity) -> Column:
    return F.greatest(F.lit(1.0), col(capacity) * 0.01)


def ape(actual, predicted) -> Column:
    a = col(actual)
    return F.try_divide(F.abs(a - col(predicted)), F.abs(a)) * 100.0


def operational_mape(actual, predicted, capacity) -> Column:
    a = col(actual)
    keep = F.abs(a) >= operational_threshold(capacity)
    return F.avg(F.when(keep, F.abs(a - col(predicted)) / F.abs(a))) * 100.0


def mae(actual, predicted) -> Column:
    return F.avg(F.abs(col(actual) - col(predicted)))


def rmse(actual, predicted) -> Column:
    e = col(actual) - col(predicted)
    return F.sqrt(F.avg(e * e))


def r2(actual, predicted) -> Column:
    """1 - SSE/SST; NULL below two rows; a constant target scores 1 or 0."""
    a, e = col(actual), col(actual) - col(predicted)
    sse, sst = F.sum(e * e), F.var_pop(a) * F.count(a)
    return (
        F.when(F.count(a) <= 1, F.lit(None).cast("double"))
        .when(sst > 0, 1.0 - F.try_divide(sse, sst))
        .when(sse == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def metric_columns(actual="actual", predicted="predicted", capacity="capacity") -> list[Column]:
    return [
        operational_mape(actual, predicted, capacity).alias("operational_mape"),
        mae(actual, predicted).alias("mae"),
        rmse(actual, predicted).alias("rmse"),
        r2(actual, predicted).alias("r2"),
    ]


def score_struct(weight: float = S.R2_WEIGHT_PRIMARY) -> Column:
    """Lexicographic candidate score over the four metric columns.

    Parts are rounded to nine decimals so that two candidates whose metrics
    differ only by summation order tie, and the tie goes to the earlier one.
    """
    m = F.coalesce(F.col("operational_mape"), F.lit(INF))
    q = F.coalesce(F.col("r2"), F.lit(-999.0))
    total = m + F.col("rmse") + (1.0 - q) * weight + F.greatest(F.lit(0.0), -q) * S.NEGATIVE_R2_PENALTY
    fine = lambda c: F.when(c == INF, c).otherwise(F.round(c, 9))
    return F.struct(
        fine(total).alias("s1"), fine(-q).alias("s2"), fine(m).alias("s3"), fine(F.col("rmse")).alias("s4")
    )


def grid(values, dtype="double") -> Column:
    """A literal parameter grid; ``explode`` it instead of joining."""
    return F.array(*[F.lit(v).cast(dtype) for v in values])


def constant_array(values) -> Column:
    """A nested list of numbers as one folded constant, whatever its length."""
    kind = "double"
    level = values
    while isinstance(level, list):
        kind, level = f"array<{kind}>", (level[0] if level else None)
    return F.from_json(F.lit(json.dumps(values)), kind) if values else F.array().cast("array<double>")


CHUNK = 65536


def _chunks(df: DataFrame, keys: list[str], position: str, chunk: int | None):
    """Rows with their chunk ``_c``; the window of a chunk; all earlier chunks of a key."""
    base = df.withColumn("_c", F.floor(F.col(position) / (chunk or CHUNK)))
    inside = Window.partitionBy(*keys, "_c").orderBy(F.col(position).asc_nulls_first())
    earlier = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    return base, inside, earlier


def _chunk_ends(base: DataFrame, keys: list[str], inside, columns: list[Column]) -> DataFrame:
    """The last row of every chunk, with window ``columns``; one sort, nothing is grouped."""
    last = F.lead(F.lit(1)).over(inside).isNull()
    return base.repartition(*keys, "_c").select(*keys, "_c", *columns, last.alias("_last")).where("_last").drop("_last")


def _with_heads(base: DataFrame, heads: DataFrame, by: list[str]) -> DataFrame:
    """Rows and ``heads`` together by chunk; heads, few, are dealt out alone first, or a task would sort for both."""
    marked = heads.repartition(*by).withColumn("_head", F.lit(True))
    return base.withColumn("_head", F.lit(False)).unionByName(marked, allowMissingColumns=True).repartition(*by)


def carry_forward(df: DataFrame, keys: list[str], position: str, columns: list[str], chunk: int | None = None) -> DataFrame:
    """Last non-null value of each column up to a row, for keys of any size.

    A key is cut into chunks of positions; within a chunk a window does the
    work, and what earlier chunks leave over precedes it as one more row.
    Chunks are dealt out anew even if the input lies by key, so a task sorts
    once: sorts that follow each other in a task hold their memory together.
    """
    base, inside, earlier = _chunks(df, keys, position, chunk)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ends = _chunk_ends(base, keys, inside, [F.last(c, True).over(upto).alias(c) for c in columns])
    left = ends.select(*keys, "_c", *[F.last(c, True).over(earlier).alias(c) for c in columns])
    heads = left.where(reduce(or_, [F.col(c).isNotNull() for c in columns]))
    rows = _with_heads(base, heads, [*keys, "_c"])
    filled = {c: F.last(c, True).over(upto).alias(c) for c in columns}
    return rows.select(*[filled.get(c, F.col(c)) for c in df.columns], "_head").where("not _head").drop("_head")


def running_number(df: DataFrame, keys: list[str], position: str, name: str, chunk: int | None = None) -> DataFrame:
    """``row_number`` within ``keys`` by an integer position, for keys of any size.

    Chunks as in :func:`carry_forward`; the row ahead of a chunk counts for all rows before it.
    """
    base, inside, earlier = _chunks(df, keys, position, chunk)
    ends = _chunk_ends(base, keys, inside, [F.row_number().over(inside).cast("bigint").alias("_n")])
    heads = ends.select(*keys, "_c", F.sum("_n").over(earlier).alias("_n")).where("_n > 0")
    rows = _with_heads(base.withColumn("_n", F.lit(1).cast("bigint")), heads, [*keys, "_c"])
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum("_n").over(upto)).where("not _head").drop("_c", "_n", "_head")


def series_window(keys, order="ts"):
    return Window.partitionBy(*keys).orderBy(order)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles for groups of any size.

    The built-in ``percentile`` keeps a whole group's values in one task. Here
    equal values are merged before the shuffle, the rest is split by sampled
    ranges, and only range totals are scanned per group.
    """
    ranked = cumulative_counts(df, keys, value)
    wanted = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()]
    )
    hit = (
        ranked.select(*keys, value, "before", "n", "total", F.explode(wanted).alias("q"))
        .withColumn("rank", F.col("q.p") * (F.col("total") - 1))
        .withColumn("lo", F.floor("rank"))
        .withColumn("hi", F.ceil("rank"))
        .withColumn("last", F.col("before") + F.col("n") - 1)
    )
    lo_in = (F.col("lo") >= F.col("before")) & (F.col("lo") <= F.col("last"))
    hi_in = (F.col("hi") >= F.col("before")) & (F.col("hi") <= F.col("last"))
    aggs = []
    for n in probs:
        mine = F.col("q.name") == n
        lo_v = F.max(F.when(mine & lo_in, F.col(value)))
        hi_v = F.max(F.when(mine & hi_in, F.col(value)))
        frac = F.max(F.when(mine, F.col("rank") - F.col("lo")))
        aggs.append((lo_v + (hi_v - lo_v) * frac).alias(n))
    return hit.where(lo_in | hi_in).groupBy(*keys).agg(*aggs)


def cumulative_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with ``n``, the rows ``before`` them and the group ``total``.

    The distinct values are dealt out by sampled ranges of (keys, value), so
    neither a large group nor a narrow range of values meets in one task; the
    ranges are written down once, as their numbers must not change on a retry.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    distinct = cut_lineage(counted.repartitionByRange(*keys, value).withColumn("bucket", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "bucket").orderBy(value)
    local = distinct.withColumn(
        "in_bucket", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    )
    over = Window.partitionBy(*keys).orderBy("bucket")
    offsets = (
        distinct.groupBy(*keys, "bucket")
        .agg(F.sum("n").alias("bn"))
        .withColumn("offset", F.sum("bn").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bn"))
        .withColumn("total", F.sum("bn").over(Window.partitionBy(*keys)))
        .drop("bn")
    )
    return (
        local.join(offsets, [*keys, "bucket"])
        .withColumn("before", F.col("in_bucket") + F.col("offset"))
        .drop("in_bucket", "offset", "bucket")
    )
