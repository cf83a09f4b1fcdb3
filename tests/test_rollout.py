import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headrace.functions import rollout_kernel as R
from headrace.operators import models as M
from headrace.operators import outage as I
from headrace.operators import rollout as J

SITES = [("a", None, 90.0, 1), ("b", "a", 60.0, 2)]


@pytest.fixture(scope="module")
def world(spark):
    """Two sites, two units each, 12 days."""
    rng = np.random.default_rng(9)
    ts = pd.date_range("2024-01-01", periods=288, freq="h")
    parts = []
    for site in "ab":
        for u, scale in (("unit1", 30), ("unit2", 15)):
            mw = np.clip(scale + 8 * np.sin(np.arange(288) / 4) + rng.normal(0, 3, 288), 0, 40).round(2)
            mw[rng.random(288) < 0.05] = 0.0
            parts.append(pd.DataFrame({"site": site, "unit": u, "ts": ts, "mw": mw}))
    units = spark.createDataFrame(pd.concat(parts)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    units = units.withColumn("available", F.when(F.col("mw") > 0, 1).otherwise(0)).cache()
    series = units.groupBy("site", "ts").agg(F.sum(F.col("mw").cast("decimal(18,2)")).cast("double").alias("total"), F.sum("available").alias("units_running")).cache()
    site_dim = spark.createDataFrame(SITES, "site string, upstream_site string, capacity double, ordinal int")
    unit_dim = units.groupBy("site", "unit").agg(F.lit(45.0).alias("capacity"))
    origins = spark.createDataFrame([("2024-01-11",), ("2024-01-12",)], "d string").select(F.col("d").cast("timestamp_ntz").alias("origin"))
    plan = I.outage_plan_last_known(units.select("site", "unit", "ts", "available"), origins)
    return dict(units=units, series=series, site_dim=site_dim, unit_dim=unit_dim, origins=origins, plan=plan)


def states(w, plan=None, **kw):
    members = kw.pop("members", None)
    return J.states(members if members is not None else J.whole_cascade(w["site_dim"]), w["series"], w["units"], w["unit_dim"],
                    w["plan"] if plan is None else plan, w["origins"], **kw)


def test_serving_features_equal_training_features(world):
    names = M.feature_names()
    frame = M.model_frame(world["series"], world["site_dim"]).toPandas().set_index(["site", "ts"])
    pdf = states(world).toPandas()
    st = R._states(pdf)
    x = R.features(st["hist"], st["up"], st["running"], st["origin"])
    assert x.shape[-1] == len(names)
    for r in range(st["R"]):
        for l, site in enumerate(st["names"][r]):
            want = frame.loc[(site, st["origin"].iloc[r] - pd.Timedelta(hours=1)), names].astype(float).fillna(0.0)
            bad = {n: (g, v) for n, g, v in zip(names, x[r, l], want) if abs(g - v) > 1e-6}
            assert not bad, (site, bad)


def test_no_model_gives_persistence(world):
    full = world["plan"].withColumn("available", F.lit(1))
    got = J.rollout_24h(states(world, full)).toPandas()
    last = world["series"].toPandas().set_index(["site", "ts"])["total"]
    want = [last[(r.site, r.origin - pd.Timedelta(hours=1))] for r in got.itertuples()]
    np.testing.assert_allclose(got["predicted"], want, atol=1e-6)
    assert len(got) == 2 * 2 * 24


@pytest.mark.parametrize("feed_back", ["backtest", "operational"])
def test_invariants_under_outage(world, feed_back):
    out = world["plan"].withColumn("available", F.when((F.col("unit") == "unit1") & (F.hour("ts") >= 6), 0).otherwise(1))
    got = J.rollout_24h(states(world, out), feed_back).toPandas()
    units = J.unit_rows(J.rollout_24h(states(world, out), feed_back)).toPandas()
    off = (units["unit"] == "unit1") & (units["h"] > 6)
    assert (units.loc[off, "mw"] == 0).all() and units["mw"].between(0, 45).all()
    sums = units.groupby(["origin", "site", "h"])["mw"].sum()
    np.testing.assert_allclose(got.set_index(["origin", "site", "h"])["predicted"].sort_index(), sums.sort_index(), atol=1e-6)
    # Base values keep being fed back only in operational mode.
    late = got[got["h"] == 20]["base_prediction"].mean()
    early = got[got["h"] == 6]["base_prediction"].mean()
    assert (late > 0.9 * early) == (feed_back == "operational")


def test_held_upstream_and_batch_independence(world):
    solo = J.rollout_24h(states(world, members=J.single_sites(world["site_dim"]))).toPandas()
    assert set(solo["cascade"]) == {"a", "b"} and (solo["cascade"] == solo["site"]).all()
    pdf = states(world).toPandas()
    whole = R.rollout(pdf, "backtest")
    one = pd.concat([R.rollout(pdf.iloc[[i]].reset_index(drop=True), "backtest") for i in range(len(pdf))])
    np.testing.assert_allclose(whole.sort_values(["origin", "site", "h"])["predicted"], one.sort_values(["origin", "site", "h"])["predicted"])


def test_ridge_fit_matches_one_solve(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    df = spark.createDataFrame(pd.DataFrame({"site": "a", "x": x.tolist(), M.TARGET: y})).repartition(5)
    row = M.rbf_regression(df, [], gamma=1.0, ridge=1e-9).first()
    np.testing.assert_allclose(row["coef"], [3.0, 1.0, -2.0, 0.5], atol=1e-6)
    assert row["rows"] == 200


def test_first_step_of_a_linear_model(spark, world):
    """Prediction = last value + shrinkage * (coef . scaled inputs) + bias."""
    names = M.feature_names()
    rng = np.random.default_rng(4)
    coef = {s: rng.normal(0, 0.3, len(names) + 1) for s in "ab"}
    mean, std = rng.normal(size=len(names)), rng.uniform(5, 9, len(names))
    rows = [(s, coef[s].tolist(), [], mean.tolist(), std.tolist(), 1.0) for s in "ab"]
    model = spark.createDataFrame(rows, "site string, coef array<double>, centers array<double>, mean array<double>, std array<double>, gamma double")
    cal = spark.createDataFrame([("a", 0.5, 1.0), ("b", 0.5, 1.0)], "site string, shrinkage double, bias double")
    frame = M.model_frame(world["series"], world["site_dim"]).toPandas().set_index(["site", "ts"])
    got = J.rollout_24h(states(world, model=model, calibration=cal)).where("h = 1").toPandas()
    caps = {s: c for s, _, c, _ in SITES}
    for r in got.itertuples():
        x = frame.loc[(r.site, r.origin - pd.Timedelta(hours=1)), names].astype(float).fillna(0.0).to_numpy()
        want = x[names.index("current")] + 0.5 * (coef[r.site][0] + ((x - mean) / std) @ coef[r.site][1:]) + 1.0
        assert abs(r.base_prediction - min(max(want, 0.0), caps[r.site] * 1.05)) < 1e-6


def test_radial_predictions_agree_between_engines(spark, world):
    names = ["current", "lag1", "lag24"]
    rows = M.model_frame(world["series"], world["site_dim"]).dropna(subset=["lag24", M.TARGET])
    scaler = M.fit_scaler(rows, names)
    scaled = M.standard_scale(rows, scaler, names)
    centers = M.kmeans_centers(scaled, 6)
    model = M.rbf_regression(scaled, centers, gamma=0.3)
    got = M.rbf_predict(scaled, model, centers).select("site", "x", "delta").toPandas()
    coef = {r.site: np.array(r.coef) for r in model.collect()}
    for site, part in got.groupby("site"):
        phi = M._phi(np.vstack(part["x"]), np.array(centers), 0.3)
        np.testing.assert_allclose(part["delta"], phi @ coef[site], atol=1e-9)


def test_centers_are_padded(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "x array<double>")
    found = M.kmeans_centers(df, 4)
    assert len(found) == 4 and found[1] == found[2] == found[3]


def test_store_retrains_on_a_different_feature_set(spark, world, tmp_path):
    names = ["current", "lag1"]
    rows = M.model_frame(world["series"], world["site_dim"]).dropna(subset=["lag1", M.TARGET])
    model = M.random_forest(rows, names, (3, 3, 2, "sqrt"))
    M.save_model(model, str(tmp_path), "forest", names)
    again, meta, retrained = M.load_model(str(tmp_path), names)
    assert not retrained and meta.first()["features"] == names
    a, b = (M.predict_delta(m, rows).agg(F.sum("delta")).first()[0] for m in (model, again))
    assert a == b
    assert M.load_model(str(tmp_path), ["current", "lag2"], lambda: "new")[::2] == ("new", True)


def test_next_day_after_the_last_row_is_forecast(spark, world):
    """An origin that has no rows of its own yet starts from the days before it."""
    origins = spark.createDataFrame([("2024-01-12",), ("2024-01-13",)], "d string").select(F.col("d").cast("timestamp_ntz").alias("origin"))
    plan = I.outage_plan_last_known(world["units"].select("site", "unit", "ts", "available"), origins).withColumn("available", F.lit(1))
    w = {**world, "origins": origins}
    got = J.rollout_24h(states(w, plan)).toPandas()
    assert got.groupby(["origin", "site"]).size().tolist() == [24] * 4
    last = world["series"].toPandas().set_index(["site", "ts"])["total"]
    want = [last[(r.site, r.origin - pd.Timedelta(hours=1))] for r in got.itertuples()]
    np.testing.assert_allclose(got["predicted"], want, atol=1e-6)


def test_same_hour_shares_of_a_partial_first_day(spark):
    """A series that starts at 05:00: the 05:00 share serves 05:00, and hours before have none."""
    ts = pd.date_range("2024-01-01 05:00", "2024-01-02 23:00", freq="h")
    rows = [("a", u, t.to_pydatetime(), float(10 + t.hour if u == "unit1" else 20)) for t in ts for u in ("unit1", "unit2")]
    units = spark.createDataFrame(rows, "site string, unit string, ts timestamp_ntz, mw double").where("ts < timestamp_ntz'2024-01-02'").unionByName(
        spark.createDataFrame([("a", u, pd.Timestamp("2024-01-02").to_pydatetime(), 1.0) for u in ("unit1", "unit2")], "site string, unit string, ts timestamp_ntz, mw double"))
    dim = units.groupBy("site", "unit").agg(F.lit(45.0).alias("capacity"))
    got = I.learned_weights(units, dim).where("unit = 'unit1' and origin = timestamp_ntz'2024-01-02'").toPandas().set_index("ts")["weight"]
    share = lambda h: (10 + h) / (30 + h)
    now, mid = share(23), np.median([share(h) for h in range(5, 24)])
    peer = np.median([1 - share(h) for h in range(5, 24)])
    mid = mid / (mid + peer)
    for h in range(24):
        parts = [(0.5, now), (0.35, mid)] + ([(0.15, share(h))] if h >= 5 else [])
        want = sum(w * p for w, p in parts) / sum(w for w, _ in parts)
        assert got[pd.Timestamp("2024-01-02") + pd.Timedelta(hours=h)] == pytest.approx(want, abs=1e-6), h


def test_unit_filling_equals_repeated_rounds():
    rng = np.random.default_rng(3)
    caps = np.where(rng.random((400, 4)) < 0.2, 0.0, rng.uniform(1, 40, (400, 4)))
    weights = np.where(rng.random((400, 4)) < 0.3, 0.0, rng.random((400, 4)))
    total = rng.uniform(-5, 130, 400)
    got = R.fill_units(total, weights, caps)
    for t, w, c, g in zip(total, weights, caps, got):
        left, room, on = max(0.0, min(t, c.sum())), c.copy(), c > 0
        out = np.zeros(4)
        while left > 1e-12 and on.any():
            share = np.where(on, w, 0.0)
            share = share if share.sum() > 0 else np.where(on, c, 0.0)
            add = np.minimum(left * share / share.sum(), room)
            out, room, left = out + add, room - add, left - add.sum()
            on = on & (room > 1e-12)
        np.testing.assert_allclose(g, out, atol=1e-6)


def test_trees_take_many_sites_and_missing_inputs(spark):
    rows = [(f"s{i % 40:02d}", float(i % 7) if i % 5 else None, float(i % 3), float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, f"site string, a double, b double, {M.TARGET} double")
    model = M.random_forest(df, ["a", "b"], (3, 3, 1, "all"))
    out = M.predict_delta(model, df.unionByName(spark.createDataFrame([("new", None, None, 0.0)], df.schema)))
    assert out.count() == 401 and out.columns == [*df.columns, "delta"] and out.where("delta is null").count() == 0


def test_cascades_are_connected_sites(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", None), ("y", "x"), ("z", "gone")]
    dim = spark.createDataFrame([(s, u, 1.0, 1) for s, u in rows], "site string, upstream_site string, capacity double, ordinal int")
    got = {r.site: r.cascade for r in J.whole_cascade(dim).collect()}
    assert got == {**dict.fromkeys("abcde", "a"), "x": "x", "y": "x", "z": "z"}
    with pytest.raises(ValueError):
        J.whole_cascade(spark.createDataFrame([("a", "c", 1.0, 1), ("b", "a", 1.0, 1), ("c", "b", 1.0, 1)], dim.schema))


def test_centers_per_site_equal_plain_rounds(spark):
    rng = np.random.default_rng(12)
    sites = [f"s{i:03d}" for i in range(100)]
    x = {s: np.round(rng.normal(size=(30 if i else 2, 3)) + i % 5, 3) for i, s in enumerate(sites)}
    df = spark.createDataFrame([(s, r.tolist()) for s, v in x.items() for r in v], "site string, x array<double>").repartition(6).cache()
    start = {r.site: np.array(r.centers) for r in M.site_centers(df, 4, rounds=0).collect()}
    got = {r.site: np.array(r.centers) for r in M.site_centers(df, 4, rounds=3, tolerance=-1.0).collect()}
    assert set(got) == set(sites)
    for s in sites:
        c = start[s].copy()
        assert all(any(np.array_equal(p, r) for r in x[s]) for p in c)
        for _ in range(3):
            near = ((x[s][:, None] - c[None]) ** 2).sum(-1).argmin(1)
            c = np.array([x[s][near == i].mean(0) if (near == i).any() else c[i] for i in range(4)])
        np.testing.assert_allclose(got[s], c)
    done = M.site_centers(df, 4)
    again = M.lloyd_round(df, done)
    assert again.agg(F.max("moved")).first()[0] <= 1e-4


def test_radial_model_with_centers_per_site(spark):
    """Thousands of sites, a few matrices held at a time."""
    rng = np.random.default_rng(13)
    rows = [(f"s{i % 5000}", rng.normal(size=2).round(3).tolist(), float(rng.normal())) for i in range(30_000)]
    df = spark.createDataFrame(rows, f"site string, x array<double>, {M.TARGET} double").repartition(4).cache()
    centers = df.groupBy("site").agg(F.slice(F.sort_array(F.collect_list("x")), 1, 3).alias("centers")).cache()
    model = M.rbf_regression(df, centers, gamma=0.7, held=7).cache()
    assert model.count() == 5000
    wanted = df.where("site in ('s0', 's17', 's4999')")
    got = M.rbf_predict(wanted, model.where("site in ('s0', 's17', 's4999')")).toPandas()
    cs = {r.site: np.array(r.centers) for r in centers.where("site in ('s0', 's17', 's4999')").collect()}
    for site, part in got.groupby("site"):
        phi = M._phi(np.vstack(part["x"]), cs[site], 0.7)
        penalty = np.diag([1e-9, 1, 1, 1])
        coef = np.linalg.solve(phi.T @ phi + penalty, phi.T @ part[M.TARGET].to_numpy())
        np.testing.assert_allclose(part["delta"], phi @ coef, atol=1e-8)


def test_bins_and_anchor_of_the_first_step(spark, world):
    """Persistence plus a bias, then bins on either basis, then the level anchor: as the one-step operators have it."""
    from headrace.operators import calibration as H

    edges = [0.0, 20.0, 35.0, 50.0, 120.0]
    fit = spark.createDataFrame(
        [("a", "pred", 0.5, edges, {0: 3.0, 1: -4.0, 2: 6.0, 3: -8.0}), ("b", "current", 1.5, edges[1:], {0: 2.0, 2: -1.0})],
        "site string, basis string, scale double, edges array<double>, corrections map<int,double>",
    )
    level = spark.createDataFrame([("a", 0.25, 0.5), ("b", 0.75, 1.0)], "site string, current_weight double, anchor_weight double")
    shrink = spark.createDataFrame([("a", 1.0, 2.5), ("b", 1.0, -1.5)], "site string, shrinkage double, bias double")
    series = world["series"]
    cap = spark.createDataFrame([(s, c) for s, _, c, _ in SITES], "site string, capacity double")
    anchors = series.select("site", (F.col("ts") + F.expr("interval 23 hours")).alias("ts"), F.col("total").alias("anchor"))
    rows = series.withColumnRenamed("total", "current").join(anchors, ["site", "ts"]).join(cap, "site").withColumn("delta", F.lit(0.0))
    steps = H.apply_shrinkage_bias(rows, shrink)
    steps = H.apply_level_anchor_blend(H.apply_bin_calibration(steps, fit), level)
    want = {(r["site"], r["ts"]): r["pred"] for r in steps.collect()}
    full = world["plan"].withColumn("available", F.lit(1))
    got = J.rollout_24h(states(world, full, calibration=J.pack_calibration(shrink, fit, level=level))).where("h = 1").collect()
    assert len(got) == 4
    for r in got:
        assert abs(r["base_prediction"] - want[r["site"], r["origin"] - pd.Timedelta(hours=1)]) < 1e-6


def test_bins_equal_a_search_per_state():
    """Bins of many states at once equal a digitize of each, edges included; states without bins have none."""
    rng = np.random.default_rng(5)
    value, base = rng.integers(0, 9, (40, 2)).astype(float), rng.integers(0, 9, (40, 2)).astype(float)
    models = {}
    for r in range(40):
        for l in range(2):
            edges = sorted(rng.choice(9, rng.integers(2, 7), replace=False).astype(float).tolist())
            models[r, l] = {"bin_edges": None if r % 5 == 0 else edges, "bin_basis": [None, "pred", "current"][r % 3],
                            "bin_shifts": [(b, float(b + 1)) for b in range(len(edges) - 1) if b != 1]}
    st = {"models": models, "bin_scale": np.where(rng.random((40, 2)) < 0.1, 0.0, 2.0)}
    got = R._bin_shift(st, value, base)
    for (r, l), m in models.items():
        want = 0.0
        if m["bin_edges"]:
            v = base[r, l] if m["bin_basis"] == "pred" else value[r, l]
            want = st["bin_scale"][r, l] * dict(m["bin_shifts"]).get(int(np.digitize(v, m["bin_edges"][1:-1])), 0.0)
        assert got[r, l] == want
