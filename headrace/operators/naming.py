"""Names, labels, timestamps and reshaping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.expr import add_hours, carry_forward, col, running_number

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Prefixes that carry no information once the measure is known.
GROUP_PREFIXES = ["generated_mw_", "outage_of_plants_", "spillage_", "spillway_gate_opening_in_meters_", "total_gate_open_per_[a-z]+_in_meters_", "elevation_"]

# Accepted spellings of model names.
MODEL_ALIASES = {
    "rbfnn": "RBFNN",
    "rbf": "RBFNN",
    "random_forest": "Random Forest",
    "randomforest": "Random Forest",
    "rf": "Random Forest",
    "xgboost": "XGBoost",
    "xgb": "XGBoost",
}


# --- names -----------------------------------------------------------------

def sanitize_name(c) -> Column:
    """Lower-case identifier: blanks, dashes and slashes become underscores."""
    x = F.lower(F.regexp_replace(col(c), r"^\s+|\s+$", ""))
    x = F.translate(F.regexp_replace(x, r"\s+", "_"), "-/().:", "__")
    return F.nullif(x, F.lit(""))


def ffill_labels(cells: DataFrame, sheet: str, position: str, levels: list[str], out: str = "label") -> DataFrame:
    """Flatten sparse header levels: all but the last are carried forward."""
    names = [f"_n{i}" for i in range(len(levels))]
    full = carry_forward(cells, [sheet], position, levels[:-1])
    flat = full.select("*", *[sanitize_name(c).alias(n) for c, n in zip(levels, names)])
    parts = F.array_compact(F.array(*names))
    has = lambda word: F.array_contains(parts, word)
    joined = F.concat_ws("_", F.filter(parts, lambda p: p != "nan"))
    label = F.when(has("date"), "date").when(has("time"), "time").when(joined == "", "unnamed").otherwise(joined)
    return flat.select(sheet, position, label.alias(out))


def suffix_repeats(labels: DataFrame, sheet: str, position: str, name: str) -> DataFrame:
    """Second and later uses of a name get ``_1``, ``_2``, ... in order."""
    k = F.col("_k") - 1
    numbered = running_number(labels, [sheet, name], position, "_k")
    return numbered.withColumn(name, F.when(k == 0, F.col(name)).otherwise(F.concat_ws("_", name, k))).drop("_k")


def standard_name(c, prefixes=GROUP_PREFIXES) -> Column:
    """One name per measure, site and unit, whatever the header nesting."""
    x = sanitize_name(c)
    for p in prefixes:
        x = F.regexp_replace(x, p, "")
    x = F.regexp_replace(x, r"(^|_)(gen|out|spill|tot|elev)_([a-z]+)_(\d)", "$1$2_$3$4")
    x = F.regexp_replace(x, r"unit_(\d+)", "unit$1")
    x = F.when(x.contains("rainfall"), F.lit("rainfall")).otherwise(x)
    x = F.regexp_replace(x, r"^(out|gen)_([a-z]+\d*)_(?:\1_)?\2_(unit\d+)$", "$1_$2_$3")
    return F.regexp_replace(x, r"^gen_([a-z]+\d*)_total_gen_\1$", "total_gen_$1")


def parse_metric_name(df: DataFrame, raw: str, sites: list[str], prefixes=GROUP_PREFIXES) -> DataFrame:
    """``raw`` -> (name, metric, site, unit)."""
    name = standard_name(raw, prefixes)
    out = df.withColumn("name", name)
    site, unit = entity_from_name("name", sites)
    metric = F.regexp_replace(F.regexp_replace("name", f"_?({'|'.join(sites)})", ""), r"_?unit\d+", "")
    return out.select("*", F.nullif(metric, F.lit("")).alias("metric"), site.alias("site"), unit.alias("unit"))


def entity_from_name(c, sites: list[str]) -> tuple[Column, Column]:
    pick = lambda pattern: F.nullif(F.regexp_extract(col(c), pattern, 1), F.lit(""))
    return pick(f"({'|'.join(sites)})"), pick(r"(unit\d+)")


def simplified_column_name(name: str) -> str:
    """Column name without unit of measure, for alias lookups."""
    return re.sub(r"[ -]", "_", re.sub(r"\(mw\)|[ _]mw", "", name.strip().lower()))


def normalize_model_name(c, fallback: str) -> Column:
    key = F.translate(F.lower(F.trim(F.coalesce(col(c), F.lit(fallback)))), "- ", "__")
    table = F.create_map(*[F.lit(x) for kv in MODEL_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(fallback))


def normalize_site_name(c, sites: list[str]) -> Column:
    key = F.translate(F.lower(F.trim(col(c))), " _", "")
    return F.when(key.isin(sites), key)


# --- values and time -------------------------------------------------------

def coerce_numeric(c) -> Column:
    """A number, or NULL for anything that does not look like one."""
    text = col(c).cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def coalesce_duplicates(columns) -> Column:
    return F.coalesce(*[coerce_numeric(c) for c in columns])


def build_timestamp(date_text, time_value) -> Column:
    """``date`` plus the hour counted 1..24; NULL when either part is bad."""
    d = col(date_text).try_cast("date").cast("timestamp_ntz")
    return add_hours(d, (coerce_numeric(time_value) - 1).cast("int"))


def parse_hour_label(text) -> Column:
    """Texts such as ``7``, ``07:00`` are 0-based and give 1..24; others are numbers as they are."""
    t = F.trim(col(text))
    hour0 = F.regexp_extract(t, r"^(\d{1,2})(:00)?$", 1).try_cast("int")
    return F.when(hour0.between(0, 23), hour0 + 1).otherwise(coerce_numeric(t).cast("int"))


def flex_timestamp(stamp, date_text, hour_text) -> Column:
    """A parseable timestamp, else date plus ``HH:MM[:SS]``, 1..24 or 0-based hour."""
    t = F.trim(col(hour_text))
    clock = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"
    part = lambda i: F.coalesce(F.regexp_extract(t, clock, i).try_cast("int"), F.lit(0))
    n = coerce_numeric(t).cast("int")
    offset = F.when(t.rlike(clock), F.make_dt_interval(F.lit(0), part(1), part(2), part(3).cast("decimal(18,6)"))).otherwise(
        F.make_dt_interval(F.lit(0), F.when(n.between(1, 24), n - 1).otherwise(n))
    )
    return F.coalesce(col(stamp).try_cast("timestamp_ntz"), col(date_text).try_cast("date").cast("timestamp_ntz") + offset)


def hour_label(hour) -> Column:
    """1..24 -> 00:00, 1:00 ... 23:00."""
    h = col(hour) - 1
    return F.when(h == 0, "00:00").otherwise(F.concat(h.cast("string"), F.lit(":00")))


# --- reshaping -------------------------------------------------------------

def project_public(wide: DataFrame, prefixes=("date", "time", "gen_", "total_gen_", "out_", "tot_", "elev_", "rainfall", "outflow")) -> DataFrame:
    """Keep the public column groups in their order, under public names."""
    names = {c: re.sub(r"^gen_([a-z]+\d*)_gen_\1_", r"gen_\1_", c) for c in wide.columns}
    names = {c: re.sub(r"^tot_([a-z]+\d*)$", r"tot_\1_gate", n) for c, n in names.items()}
    kept = dict.fromkeys(c for p in prefixes for c in wide.columns if c.startswith(p))
    return wide.select(*[F.col(c).alias(names[c]) for c in kept])


def with_aliases(wide: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Back-compatible copies: {new name: existing column}."""
    return wide.select("*", *[F.col(src).alias(dst) for dst, src in aliases.items() if dst not in wide.columns])


def normalize_forecast(raw: DataFrame, sites: list[str], group: list[str] = ()) -> DataFrame:
    """One forecast in a fixed layout; anything but 24 rows fails the job."""
    lookup = {simplified_column_name(c): c for c in raw.columns}

    def total(site):
        for alias in (f"total_gen_{site}", f"total_generation_{site}", f"total_{site}"):
            if alias in lookup:
                return coerce_numeric(F.col(f"`{lookup[alias]}`"))
        raise ValueError(f"forecast is missing the total of {site}")

    hour = lookup.get("hour") or lookup.get("time")
    stamp = F.col(f"`{lookup['datetime']}`") if "datetime" in lookup else F.lit(None).cast("string")
    ts = flex_timestamp(stamp, F.col(f"`{lookup['date']}`").cast("string"), F.col(f"`{hour}`").cast("string"))
    given = next((lookup[a] for a in ("total_cascade_generation", "cascade_generation", "total_cascade") if a in lookup), None)
    out = raw.select(*group, ts.alias("ts"), *[total(s).alias(f"total_gen_{s}") for s in sites],
                     *([coerce_numeric(F.col(f"`{given}`")).alias("_given")] if given else []))
    summed = sum((F.coalesce(F.col(f"total_gen_{s}"), F.lit(0.0)) for s in sites), F.lit(0.0))
    # One forecast is 24 rows, so ordering it in one group is bounded; a 25th row is enough to refuse it.
    out = out if group else out.limit(S.HORIZON + 1)
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    checked = out.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "forecast_hour",
        F.when(F.col("_n") == S.HORIZON, F.row_number().over(w.orderBy(F.col("ts").asc_nulls_last())))
        .otherwise(F.raise_error(F.lit("a day-ahead forecast must contain exactly 24 rows")).cast("int")),
    )
    return checked.select(
        *group, "ts", F.to_date("ts").alias("date"), "forecast_hour", *[f"total_gen_{s}" for s in sites],
        (F.col("_given") if given else summed).alias("total_cascade_generation"),
    )


def normalize_predictions(raw: DataFrame, fallback_model: str, sites: list[str]) -> DataFrame:
    """Aliases resolved, names normalised, bad rows dropped, one row per (model, site, ts)."""
    lookup = {simplified_column_name(c): c for c in raw.columns}
    first = lambda *names: next((F.col(f"`{lookup[n]}`") for n in names if n in lookup), None)
    source = {
        "plant": first("plant", "site"),
        "actual_generation": first("actual_generation", "actual"),
        "predicted_generation": first("predicted_generation", "prediction", "forecast"),
    }
    missing = [n for n, c in source.items() if c is None]
    if missing:
        raise ValueError(f"predictions are missing required columns: {missing}")
    text = lambda *n: (F.lit(None) if first(*n) is None else first(*n)).cast("string")
    ts = flex_timestamp(text("datetime", "ts"), text("date"), text("hour", "time"))
    model = F.lit(fallback_model) if first("model") is None else normalize_model_name(first("model"), fallback_model)
    out = raw.select(
        model.alias("model"), normalize_site_name(source["plant"], sites).alias("site"), ts.alias("ts"),
        coerce_numeric(source["actual_generation"]).alias("actual"),
        coerce_numeric(source["predicted_generation"]).alias("predicted"),
    ).dropna()
    # The minimum struct is a deterministic "first row", merged before the shuffle.
    return (
        out.groupBy("model", "site", "ts")
        .agg(F.min(F.struct("actual", "predicted")).alias("r"))
        .select("model", "site", "ts", "r.actual", "r.predicted")
    )


def align_features(df: DataFrame, saved: list[str], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns a saved model expects, in its order; absent ones are zero."""
    missing = [c for c in saved if c not in df.columns]
    cols = [F.lit(0.0).alias(c) if c in missing else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in saved]
    return df.select(*keep, *cols), missing


def melt_totals(wide: DataFrame, sites: list[str], ids: list[str]) -> DataFrame:
    tall = wide.unpivot(ids, [f"total_gen_{s}" for s in sites], "name", "mw")
    return tall.select(*ids, F.regexp_replace("name", "^total_gen_", "").alias("site"), "mw")


def pivot_models(metrics: DataFrame, models: list[str], value: str) -> DataFrame:
    return metrics.groupBy("site").pivot("model", models).agg(F.first(value))


def ordered_category(df: DataFrame, site_dim: DataFrame) -> DataFrame:
    """Attach the cascade ordinal so that sorting follows the river."""
    return df.join(site_dim.select("site", "ordinal"), "site", "left")


def metric_frame_split(metrics: DataFrame, names=("operational_mape", "mae", "rmse", "r2")) -> DataFrame:
    """val_* / test_* columns of one row -> one row per split."""
    return metrics.select(
        "model", "site", "feature_count",
        F.explode(F.array(*[
            F.struct(F.lit(split).alias("split"), *[F.col(f"{p}_{n}").alias(n) for n in names])
            for split, p in (("validation", "val"), ("testing", "test"))
        ])).alias("m"),
    ).select("model", "site", "feature_count", "m.*")
