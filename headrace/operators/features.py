"""Feature columns: windows over one ordering per series.

All lags, leads and rolling frames of a series share one partitioning and
ordering, so the whole family costs one shuffle and one sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import add_hours, col, series_window
from .slices import assert_before_origin, last_known


def _wave(x, period: float, prefix: str) -> list[Column]:
    angle = F.lit(2.0) * F.pi() * x / period
    return [F.sin(angle).alias(f"{prefix}_sin"), F.cos(angle).alias(f"{prefix}_cos")]


def calendar_features(ts="ts", prefix: str = "", month: bool = True) -> list[Column]:
    ts = col(ts)
    out = _wave(F.hour(ts), 24.0, f"{prefix}hour") + _wave(F.weekday(ts), 7.0, f"{prefix}day")
    if month:
        out += _wave(F.month(ts), 12.0, f"{prefix}month")
    return out + [F.when(F.weekday(ts) >= 5, 1).otherwise(0).alias(f"{prefix}is_weekend")]


def target_calendar(ts="ts") -> list[Column]:
    return calendar_features(add_hours(ts, 1), "target_", month=False)


def lead_target(value: str, w) -> list[Column]:
    ahead = F.lead(value, 1).over(w)
    return [F.col(value).alias("current"), ahead.alias("tplus1"), (ahead - F.col(value)).alias("delta_tplus1")]


def lags(value: str, w, offsets=S.LAGS, prefix: str = "lag") -> list[Column]:
    return [F.lag(value, n).over(w).alias(f"{prefix}{n}") for n in offsets]


PARTS = ("n", "mean", "m2", "min", "max")
MAX_TILES = 8


def rolling_names(windows=S.ROLL_WINDOWS) -> list[str]:
    return [f"roll{stat}{n}" for n in windows for stat in ("mean", "std", "min", "max")]


def _frame_parts(value: str, w, n: int) -> list[Column]:
    f = w.rowsBetween(-(n - 1), 0)
    size = F.count(value).over(f)
    stats = [size, F.avg(value).over(f), F.var_pop(value).over(f) * size, F.min(value).over(f), F.max(value).over(f)]
    return [c.alias(f"_{p}{n}") for p, c in zip(PARTS, stats)]


def _tile(df: DataFrame, w, tile: int, targets: list[int]) -> DataFrame:
    """Statistics of longer windows from those of the ``tile`` rows they consist of."""
    back = range(1, max(targets) // tile)
    shifted = df.select("*", *[F.lag(f"_{p}{tile}", tile * k).over(w).alias(f"_{p}_{k}") for k in back for p in PARTS])
    at = lambda p, k: F.col(f"_{p}{tile}") if k == 0 else F.col(f"_{p}_{k}")
    or0 = lambda c: F.coalesce(c, F.lit(0))
    tiles = {n: range(n // tile) for n in targets}
    sums = {f"_n{n}": sum((or0(at("n", k)) for k in ks), F.lit(0)) for n, ks in tiles.items()}
    means = {f"_mean{n}": F.try_divide(sum((or0(at("n", k) * at("mean", k)) for k in ks), F.lit(0.0)), F.col(f"_n{n}")) for n, ks in tiles.items()}
    rest = {}
    for n, ks in tiles.items():
        off = lambda k: at("mean", k) - F.col(f"_mean{n}")
        rest[f"_m2{n}"] = sum((or0(at("m2", k) + at("n", k) * off(k) * off(k)) for k in ks), F.lit(0.0))
        rest[f"_min{n}"] = F.least(*[at("min", k) for k in ks])
        rest[f"_max{n}"] = F.greatest(*[at("max", k) for k in ks])
    return shifted.withColumns(sums).withColumns(means).withColumns(rest).drop(*[f"_{p}_{k}" for k in back for p in PARTS])


def rolling_stats(df: DataFrame, keys: list[str], value: str, ts: str = "ts", windows=S.ROLL_WINDOWS) -> DataFrame:
    """Trailing mean/std/min/max including the current row.

    A window needs max(2, w // 2) values; a missing deviation counts as zero.
    A sliding frame costs its length for every row, so only the shortest one is
    computed that way; 6, 12 and 24 are put together from windows of 3, and 48
    and 168 from windows of 24, read with ``lag`` under the same ordering.
    """
    w = series_window(keys, ts)
    todo, ready = sorted(windows), []
    out = df
    while todo:
        # The longest finished window of which something left is a small multiple.
        tile = next((t for t in reversed(ready) if any(n % t == 0 and n // t <= MAX_TILES for n in todo)), None)
        if tile is None:
            out, made = out.select("*", *_frame_parts(value, w, todo[0])), [todo[0]]
        else:
            made = [n for n in todo if n % tile == 0 and n // tile <= MAX_TILES]
            out = _tile(out, w, tile, made)
        ready, todo = sorted(ready + made), [n for n in todo if n not in made]
    stats = []
    for n in windows:
        enough, m2 = F.col(f"_n{n}") >= max(2, n // 2), F.col(f"_m2{n}")
        std = F.sqrt(m2 / F.greatest(F.col(f"_n{n}") - 1, F.lit(1)))
        stats += [
            F.when(enough, F.col(f"_mean{n}")).alias(f"rollmean{n}"), F.when(enough, std).otherwise(0.0).alias(f"rollstd{n}"),
            F.when(enough, F.col(f"_min{n}")).alias(f"rollmin{n}"), F.when(enough, F.col(f"_max{n}")).alias(f"rollmax{n}"),
        ]
    return out.select(*df.columns, *stats)


def diffs(value: str, w, offsets=S.DIFFS) -> list[Column]:
    return [(F.col(value) - F.lag(value, n).over(w)).alias(f"diff{n}") for n in offsets]


def target_lags(value: str, w) -> list[Column]:
    """Same hour yesterday and last week, seen from the hour to be predicted."""
    return [F.lag(value, 23).over(w).alias("target_lag24"), F.lag(value, 167).over(w).alias("target_lag168")]


def unit_share(value: str, total: str) -> Column:
    return F.coalesce(F.try_divide(col(value), col(total)), F.lit(0.0))


def unit_lags_shares(units: DataFrame, offsets=S.LAGS, value: str = "mw", ts: str = "ts") -> DataFrame:
    """Unit output, its share of the site total, and the lags of both.

    The site total comes from a window over (site, ts): the units of one site
    at one hour, a handful of rows, so no second copy of the data is joined.
    """
    peers = Window.partitionBy("site", ts)
    total = F.sum(F.coalesce(F.col(value), F.lit(0.0)).cast("decimal(18,6)")).over(peers).cast("double")
    shared = units.select("site", "unit", ts, value, unit_share(value, total).alias("share"))
    w = series_window(["site", "unit"], ts)
    return shared.select("site", "unit", ts, value, "share", *lags(value, w, offsets), *lags("share", w, offsets, "share_lag"))


def units_running(units: DataFrame, ts: str = "ts") -> DataFrame:
    n = F.sum("available")
    return units.groupBy("site", ts).agg(n.alias("units_running"), F.when(n > 0, 1).otherwise(0).alias("plant_available"))


def upstream_features(series: DataFrame, edges: DataFrame, value: str = "total", ts: str = "ts", offsets=S.LAGS) -> DataFrame:
    """Current value and lags of the upstream site; works for any edge table.

    ``edges`` (site, upstream_site) comes from the site dimension; lags are
    taken once per upstream series and then handed to its downstream sites.
    """
    w = series_window(["site"], ts)
    ups = series.select(
        F.col("site").alias("upstream_site"), ts, F.col(value).alias("upstream_current"),
        *lags(value, w, offsets, "upstream_gen_lag"),
    )
    return ups.join(edges.where("upstream_site is not null"), "upstream_site")


def hydro_lags(df: DataFrame, keys: list[str], channels: list[str], ts: str = "ts", offsets=S.HYDRO_LAGS) -> DataFrame:
    w = series_window(keys, ts)
    return df.select(*keys, ts, *[c for ch in channels for c in lags(ch, w, offsets, f"{ch}_lag")])


def site_features(series: DataFrame, keys: list[str] = ("site",), value: str = "total", ts: str = "ts") -> DataFrame:
    """Every site-level family at once: one shuffle, one sort."""
    keys = list(keys)
    w = series_window(keys, ts)
    return rolling_stats(series, keys, value, ts).select(
        *series.columns, *calendar_features(ts), *target_calendar(ts), *lead_target(value, w), *lags(value, w),
        *rolling_names(), *diffs(value, w), *target_lags(value, w),
    )


FEATURE_PATTERN = re.compile(
    r"(target_)?(hour|day|month)_(sin|cos)|(target_)?is_weekend|current|lag\d+|roll(mean|std|min|max)\d+|diff\d+"
    r"|target_lag\d+|upstream_\w+|unit\d+_(current|lag\d+|share_current|share_lag\d+)|units_running|plant_available"
    r"|(gate|level|outflow|rain)_lag\d+|(gate|level)"
)


def feature_select(columns: list[str]) -> list[str]:
    """Model inputs in a stable order; same-hour rain and outflow are refused."""
    chosen = list(dict.fromkeys(c for c in columns if FEATURE_PATTERN.fullmatch(c)))
    leaks = [c for c in columns if re.fullmatch(r"rain|outflow|rainfall", c) and c in chosen]
    if leaks:
        raise ValueError(f"same-hour context must not be a feature: {leaks}")
    return chosen


def serving_row(last: DataFrame, names: list[str], origin: str = "origin", step: int | Column = 1) -> DataFrame:
    """Inputs for ``origin + step``: lags from the last row, calendar of the target hour.

    Calendar fields describe the predicted hour both here and in training. A step
    that is a column is returned as ``h``.
    """
    target = add_hours(origin, step - 1)
    fields = {}
    for prefix in ("", "target_"):
        cols = calendar_features(target, prefix, month=(prefix == ""))
        tags = ["hour_sin", "hour_cos", "day_sin", "day_cos"] + (["month_sin", "month_cos"] if prefix == "" else []) + ["is_weekend"]
        fields.update({prefix + t: c for t, c in zip(tags, cols)})
    return last.select(
        "site", origin, *([] if isinstance(step, int) else [step.alias("h")]),
        *[(fields[n] if n in fields else F.coalesce(F.col(n).cast("double"), F.lit(0.0))).alias(n) for n in names],
    )


def serving_rows(frame: DataFrame, names: list[str], origins: DataFrame, steps: int = S.HORIZON) -> DataFrame:
    """(site, origin, h, inputs) for every origin and step, from the training frame itself.

    The as-of step keeps a day's last row, so no row meets more origins than it
    serves; steps are exploded last. Sites without a row before an origin have none.
    """
    inputs = [n for n in names if n in frame.columns]
    known = last_known(frame.select("site", "ts", F.struct(*inputs).alias("_row")), ["site"], "_row", origins)
    checked = assert_before_origin(known, "ts_known").where("ts_known is not null")
    each = checked.select("site", "origin", "_row.*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_h"))
    return serving_row(each, names, step=F.col("_h"))
