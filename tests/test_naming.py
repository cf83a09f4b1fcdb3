import pytest
from pyspark.sql import functions as F

from headrace.operators import naming as N
from headrace.operators.features import feature_select


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [("  Gen - A / Unit 1 ", "gen___a___unit_1"), ("Rain (mm.)", "rain_mm"), ("a:b", "ab"), ("   ", None), (None, None)])
def test_sanitize(spark, raw, want):
    assert one(spark, N.sanitize_name("x"), x=raw) == want


@pytest.mark.parametrize("raw,want", [("0:00", 1), ("00:00", 1), ("7", 8), ("23:00", 24), ("24", 24), ("x", None)])
def test_hour_labels(spark, raw, want):
    assert one(spark, N.parse_hour_label("x"), x=raw) == want


@pytest.mark.parametrize("stamp,date,hour,want", [
    ("2024-01-01 05:06:07", "x", "x", "2024-01-01 05:06:07"), (None, "2024-01-02", "07:30", "2024-01-02 07:30:00"),
    (None, "2024-01-02", "1", "2024-01-02 00:00:00"), (None, "2024-01-02", "24", "2024-01-02 23:00:00"),
    (None, "2024-01-02", "0", "2024-01-02 00:00:00"), (None, "bad", "3", None),
])
def test_flexible_timestamp(spark, stamp, date, hour, want):
    got = one(spark, N.flex_timestamp("s", "d", "h"), s=stamp, d=date, h=hour)
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize("raw,want", [
    ("gen_abc_1_abc_1_unit2", "gen_abc1_abc_1_unit2"), ("gen_abc1_gen_abc1_unit2", "gen_abc1_unit2"), ("out_abc1_abc1_unit1", "out_abc1_unit1"),
    ("gen_abc1_total_gen_abc1", "total_gen_abc1"), ("Daily Rainfall (mm)", "rainfall"), ("Total Gate Open per Abc in meters Tot Abc 1", "tot_abc1"), ("Spillway Gate Opening in meters Spill Abc 4 Gate 2", "spill_abc4_gate_2"),
])
def test_standard_names(spark, raw, want):
    assert one(spark, N.standard_name("x"), x=raw) == want


def test_forecast_must_have_24_rows(spark):
    df = spark.range(23).select(F.lit("2024-01-01").alias("Date"), (F.col("id") + 1).alias("Hour"), F.lit(1.0).alias("Total_Gen_A_MW"))
    with pytest.raises(Exception, match="exactly 24 rows"):
        N.normalize_forecast(df, ["a"]).collect()
    with pytest.raises(ValueError, match="missing the total"):
        N.normalize_forecast(df, ["b"])


def test_feature_selection_refuses_labels():
    chosen = feature_select(["ts", "lag1", "tplus1", "delta_tplus1", "rain", "rain_lag3", "current", "lag1"])
    assert chosen == ["lag1", "rain_lag3", "current"]
