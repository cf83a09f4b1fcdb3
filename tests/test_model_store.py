import pytest
from pyspark.sql import functions as F

from headrace.operators import trees as T
from headrace.sources import model_store as K

INPUTS = ["x", "z"]


@pytest.fixture(scope="module")
def trees(spark):
    rows = [(s, float(i), float(i * i % 7), float((i % 5) * (1 if s == "a" else -2))) for s in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "site string, x double, z double, y double").cache()
    models = T.fit(df, INPUTS, "forest", [(5, 3, 2, "sqrt")], y="y").cache()
    return df, models


def linear(spark, weights):
    rows = [(s, [0.0, w], [], [0.0], [1.0], 1.0, 60) for s, w in weights.items()]
    kind = "site string, coef array<double>, centers array<double>, mean array<double>, std array<double>, gamma double, rows long"
    return spark.createDataFrame(rows, kind).withColumn("family", F.lit("radial"))


def weights(models):
    return {r["site"]: r["coef"][1] for r in K.family(models, "radial").collect()}


def test_families_side_by_side_and_partial_retraining(spark, trees, tmp_path):
    df, models = trees
    path = str(tmp_path / "store")
    assert K.current_version(spark, path) is None
    with pytest.raises(ValueError, match="no models"):
        K.load_models(spark, path, INPUTS)
    first = K.save_models(linear(spark, {"a": 1.0, "b": 2.0}), INPUTS, path)
    K.save_models(models, INPUTS, path)
    K.save_models(linear(spark, {"b": 5.0}), INPUTS, path)
    stored, inputs, retrained = K.load_models(spark, path, INPUTS[::-1])
    assert inputs == INPUTS and not retrained and stored.count() == 4
    assert weights(stored) == {"a": 1.0, "b": 5.0}
    # Earlier versions stay readable, and trees predict the same from the store.
    assert weights(K.load_models(spark, path, INPUTS, version=first)[0]) == {"a": 1.0, "b": 2.0}
    same = lambda m: sorted(map(tuple, T.predict(df, m, INPUTS).select("site", "x", "delta").collect()))
    assert same(K.family(stored, "forest")) == same(models)


def test_other_inputs_train_again(spark, trees, tmp_path):
    _, models = trees
    path = str(tmp_path / "store")
    K.save_models(models, INPUTS, path)
    with pytest.raises(ValueError, match="other inputs"):
        K.load_models(spark, path, ["x"])
    stored, inputs, retrained = K.load_models(spark, path, ["x"], lambda: linear(spark, {"a": 3.0}))
    assert (inputs, retrained, weights(stored), stored.count()) == (["x"], True, {"a": 3.0}, 1)
    assert K.load_models(spark, path, ["x"])[2] is False


def test_rows_without_manifest_are_not_in_force(spark, tmp_path):
    """A save that dies before its manifest row changes nothing."""
    path = str(tmp_path / "store")
    K.save_models(linear(spark, {"a": 1.0}), INPUTS, path)
    K._rows(linear(spark, {"a": 9.0})).write.parquet(f"{path}/models/version=half")
    assert weights(K.load_models(spark, path, INPUTS)[0]) == {"a": 1.0}


def test_stored_blend_overrides(spark, tmp_path):
    fit = spark.createDataFrame([("a", 1.0, 0.4), ("b", 1.0, 0.4), ("c", 1.0, None)], "site string, shrinkage double, blend_weight double")
    tuned = spark.createDataFrame(
        [("m", "a", 0.7, True), ("m", "b", 0.7, False), ("n", "b", 0.9, True), ("m", "c", 0.2, True)], "model string, site string, weight double, adopted boolean"
    )
    path = str(tmp_path / "store")
    K.save_models(linear(spark, {"a": 1.0, "b": 1.0, "c": 1.0}), INPUTS, path, K.with_saved_blend(fit, tuned, "m"))
    got = K.serving_calibration(K.load_models(spark, path, INPUTS)[0], "radial")
    assert {r["site"]: r["blend_weight"] for r in got.collect()} == {"a": 0.7, "b": 0.4, "c": 0.2}
