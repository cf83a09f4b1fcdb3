import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_rollout import SITES, states, world  # noqa: F401

from headrace import settings as S
from headrace.functions import rollout_kernel as R
from headrace.functions import tree_kernel as K
from headrace.operators import models as M
from headrace.operators import rollout as J
from headrace.operators import selection as Z
from headrace.operators import trees as T


def naive_split(x, y, w, leaf, l2):
    """Gain of the best split over all inputs and all places between neighbouring values."""
    gain = lambda i: (w[i] * y[i]).sum() ** 2 / (w[i].sum() + l2) if i.any() else 0.0
    best, used = 0.0, w > 0
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for cut in (v[1:] + v[:-1]) / 2:
            left, right = used & (x[:, f] <= cut), used & (x[:, f] > cut)
            if left.sum() >= leaf and right.sum() >= leaf:
                best = max(best, gain(left) + gain(right) - gain(used))
    return best


def every(inputs):
    return lambda nodes: np.broadcast_to(np.arange(inputs), (nodes, inputs))


@pytest.mark.parametrize(("leaf", "l2"), [(1, 0.0), (3, 1.5), (8, 20.0)])
def test_splits_equal_naive_search(leaf, l2):
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = rng.integers(0, 9, (40, 4)).astype(float)
        y, w = rng.normal(size=40), rng.integers(0, 3, (2, 40)).astype(float)
        cuts = K.cut_points(x)
        trees = K.grow(K.to_bins(x, cuts), cuts, y, w, 1, leaf, l2, every(4))
        for t in range(2):
            own, want = w[t], naive_split(x, y, w[t], leaf, l2)
            root = trees["roots"][t]
            f = trees["feature"][root]
            assert (f < 0) == (want <= 1e-9)
            if f >= 0:
                left = x[:, f] <= trees["threshold"][root]
                score = lambda i: (own[i] * y[i]).sum() ** 2 / (own[i].sum() + l2)  # noqa: B023, E731
                used = np.ones(40, bool)
                assert score(left) + score(~left) - score(used) == pytest.approx(want)
                assert trees["value"][trees["left"][root]] == pytest.approx((own[left] * y[left]).sum() / (own[left].sum() + l2))


def test_depth_leaf_and_walk():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 5)).round(1), rng.normal(size=200)
    cuts = K.cut_points(x)
    for depth, leaf in ((0, 1), (2, 1), (4, 10), (None, 5)):
        trees = K.grow(K.to_bins(x, cuts), cuts, y, np.ones((3, 200)), depth, leaf, 0.0, every(5))
        total = np.zeros(200)
        for i, row in enumerate(x):
            for node in trees["roots"].tolist():
                steps = 0
                while trees["feature"][node] >= 0:
                    node = (trees["left"] if row[trees["feature"][node]] <= trees["threshold"][node] else trees["right"])[node]
                    steps += 1
                assert depth is None or steps <= depth
                total[i] += trees["value"][node]
        np.testing.assert_allclose(K.leaves(x, trees), total)
        inner = trees["feature"] >= 0
        assert inner.sum() * 2 + 3 == inner.size
        # Equal trees: each leaf's value is the mean of at least ``leaf`` rows.
        one = np.unique(total / 3, return_counts=True)[1]
        assert depth == 0 or one.min() >= leaf


def test_chunked_sums_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(90, 7)), rng.normal(size=90)
    cuts = K.cut_points(x)
    whole = K.grow(K.to_bins(x, cuts), cuts, y, np.ones((4, 90)), 4, 2, 0.0, every(7))
    monkeypatch.setattr(K, "CHUNK", 300)
    part = K.grow(K.to_bins(x, cuts), cuts, y, np.ones((4, 90)), 4, 2, 0.0, every(7))
    assert all(np.array_equal(whole[k], part[k]) for k in K.ARRAYS[:4])
    values = K.leaves(x, part)
    monkeypatch.undo()
    np.testing.assert_allclose(values, K.leaves(x, whole))


def test_many_values_are_cut_at_quantiles():
    x = np.arange(5000.0)[:, None]
    cuts = K.cut_points(x)
    assert cuts[0].size < K.BINS and K.to_bins(x, cuts).max() == cuts[0].size
    assert K.cut_points(np.ones((5, 1)))[0].size == 0


@pytest.mark.parametrize("family", ["forest", "boosting"])
def test_families_learn(family):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0)
    config = (80, 10, 2, "0.75") if family == "forest" else (150, 0.1, 4, 0.9, 0.9, 1.0)
    base, trees = K.FAMILIES[family](x[:500], y[:500], config, np.random.default_rng(1))
    error = base + K.leaves(x[500:], trees) - y[500:]
    assert 1 - (error**2).mean() / y[500:].var() > 0.75
    base, trees = K.FAMILIES[family](x[:3], np.full(3, 2.0), config, np.random.default_rng(1))
    np.testing.assert_allclose(base + K.leaves(x[:9], trees), 2.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    n = 240
    pdf = pd.DataFrame({"site": np.repeat(["a", "b", "c"], n // 3), "i": range(n), "u": rng.normal(size=n).round(2), "v": rng.integers(0, 4, n).astype(float)})
    pdf["y"] = pdf["u"] * (pdf["v"] > 1) + (pdf["site"] == "b")
    pdf.loc[::17, "u"] = np.nan
    pdf.loc[::23, "y"] = np.nan
    pdf.loc[pdf["site"] == "c", "y"] = np.nan
    return spark.createDataFrame(pdf).replace(float("nan"), None)


POINTS = [(9, 0.3, 2, 0.8, 1.0, 1.0), (4, 0.3, 3, 1.0, 1.0, 0.5)]


def test_fit_does_not_depend_on_partitions_and_predicts_every_row(rows):
    one = {(r.site, r.point): r for r in T.fit(rows, ["u", "v"], "boosting", POINTS, y="y").collect()}
    two = {(r.site, r.point): r for r in T.fit(rows.orderBy(F.desc("i")).repartition(5), ["u", "v"], "boosting", POINTS, y="y").collect()}
    assert one == two and set(one) == {(s, p) for s in "ab" for p in (1, 2)}
    assert one["a", 1]["rows"] == rows.where("site = 'a' and y is not null").count()
    spark = rows.sparkSession
    got = T.predict(rows, spark.createDataFrame(list(one.values()), T.MODEL), ["u", "v"])
    assert got.groupBy("site", "point").count().count() == 4 and got.count() == 320
    empty = T.predict(rows, spark.createDataFrame([], T.MODEL), ["u", "v"])
    assert empty.count() == 0 and empty.columns[-1] == "delta"


def test_nodes_table_gives_the_same_predictions(rows):
    model = T.fit(rows, ["u", "v"], "boosting", POINTS[:1], y="y").cache()
    want = {r.i: r.delta for r in T.predict(rows, model, ["u", "v"]).collect()}
    nodes = {}
    for r in T.nodes(model).collect():
        nodes.setdefault(r.site, {})[r.node] = r
    for r in rows.where("site <> 'c'").collect():
        own, total = nodes[r.site], 0.0
        for node in own.values():
            if node.is_root:
                while node.feature >= 0:
                    value = (r.u, r.v)[node.feature] or 0.0
                    node = own[node.left if value <= node.threshold else node.right]
                total += node.value
        assert want[r.i] == pytest.approx(node.base + total)


def test_search_points(spark):
    dim = spark.createDataFrame(SITES, "site string, upstream_site string, capacity double, ordinal int")
    got = T.search_points("forest", dim).groupBy("site").count().collect()
    assert dict(map(tuple, got)) == {"a": 4, "b": 6}
    assert T.search_points("boosting", dim).where("site = 'b'").count() == len(S.BOOSTING_CONFIGS)


def train_frame(w):
    return M.model_frame(w["series"], w["site_dim"]).dropna(subset=["lag168", "target_lag168", M.TARGET])


@pytest.mark.parametrize(("family", "config"), [("forest", (20, 6, 3, "sqrt")), ("boosting", (25, 0.1, 3, 0.9, 0.9, 1.0))])
def test_rollout_with_trees(world, family, config):  # noqa: F811
    names = M.feature_names()
    frame = train_frame(world).cache()
    model = T.fit(frame, names, family, [config]).cache()
    state = states(world, world["plan"].withColumn("available", F.lit(1)))
    out = J.rollout_24h(state, trees=model).toPandas()
    assert (out.groupby(["site", "origin"])["h"].nunique() == 24).all() and len(out) == 2 * 2 * 24
    # The first step is the one-step prediction of the row before the origin.
    every = M.model_frame(world["series"], world["site_dim"])
    delta = {(r.site, r.ts): r.current + r.delta for r in T.predict(every.select("site", "ts", *names), model, names).collect()}
    capacity = {s: c for s, _, c, _ in SITES}
    for r in out[out["h"] == 1].itertuples():
        want = np.clip(delta[r.site, r.origin - pd.Timedelta(hours=1)], 0, capacity[r.site] * S.CAPACITY_HEADROOM)
        assert r.base_prediction == pytest.approx(want, abs=1e-6)
    # Sites without an ensemble hold their value; slices and groups of days change nothing.
    part = J.rollout_24h(state, trees=model.where("site = 'a'")).toPandas()
    b = part[part["site"] == "b"].groupby("origin")["base_prediction"]
    assert (b.max() - b.min() < 1e-9).all()
    R.SLICE, J.ORIGINS_TOGETHER, was = 1, 1, (R.SLICE, J.ORIGINS_TOGETHER)
    again = J.rollout_24h(state, trees=model).toPandas()
    R.SLICE, J.ORIGINS_TOGETHER = was
    order = ["site", "origin", "h"]
    np.testing.assert_allclose(again.sort_values(order)["predicted"], out.sort_values(order)["predicted"])


def test_selection_over_points_and_shrinkage(world):  # noqa: F811
    names = M.feature_names()
    frame = train_frame(world).cache()
    good, bad = (25, 0.1, 3, 0.9, 0.9, 1.0), (1, 1e-6, 1, 1.0, 1.0, 1.0)
    models = T.fit(frame, names, "boosting", [bad, good]).cache()
    caps = world["site_dim"].select("site", "capacity")
    ahead = T.predict(frame.select("site", "tplus1", *names), models, names).join(caps, "site").select("site", "point", "current", "delta", F.col("tplus1").alias("actual"), "capacity").cache()
    top = Z.screen_points(ahead, 3, S.R2_WEIGHT_RIVAL).collect()
    by_hand = {}
    pdf = ahead.toPandas()
    for site, point, s in itertools.product("ab", (1, 2), S.SHRINKAGE_GRID):
        p = pdf[(pdf["site"] == site) & (pdf["point"] == point)]
        cap = p["capacity"].iloc[0]
        cand = np.clip(p["current"] + s * p["delta"], 0, cap * S.CAPACITY_HEADROOM)
        e, on = p["actual"] - cand, p["actual"].abs() >= max(1.0, 0.01 * cap)
        r2 = 1 - (e**2).sum() / ((p["actual"] - p["actual"].mean()) ** 2).sum()
        score = 100 * (e.abs() / p["actual"].abs())[on].mean() + np.sqrt((e**2).mean()) + (1 - r2) * S.R2_WEIGHT_RIVAL + max(0, -r2) * S.NEGATIVE_R2_PENALTY
        by_hand.setdefault(site, []).append((round(score, 6), point, s))
    for site in "ab":
        assert [(r.point, r.shrinkage) for r in sorted((r for r in top if r.site == site), key=lambda r: r.rank)] == [x[1:] for x in sorted(by_hand[site])[:3]]
    make = lambda members, calibration: states(world, members=members, calibration=calibration, calibration_keys=("cascade", "site"))
    picked = Z.select_models(ahead, models, make, J.single_sites(world["site_dim"]), world["series"], world["site_dim"]).collect()
    assert {r.site for r in picked} == {"a", "b"} and all(r.finalists == 3 and r.forecast_days == 2 for r in picked)
    chosen = {(r.site, r.point, r.shrinkage) for r in top}
    assert all((r.site, r.point, r.shrinkage) in chosen for r in picked)
