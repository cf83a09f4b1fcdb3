import math

import numpy as np
import pandas as pd
import pytest

from headrace.functions.knn_kernel import lower_bounds, nearest, nearest_pivot, visits
from headrace.operators import cleaning as C


def collect(df, value="x"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["site"], r["ts"])):
        out.setdefault(r["site"], []).append(math.nan if r[value] is None else r[value])
    return out


def sequential_smooth(x, factor=3.5):
    y = list(x)
    for i in range(1, len(y) - 1):
        p, c, n = y[i - 1], y[i], y[i + 1]
        if not any(v != v for v in (p, c, n)) and abs(c - (p + n) / 2) > factor * max(abs(p - n) + 1e-6, 1.0):
            y[i] = (p + n) / 2
    return y


def random_series(seed, n=120, holes=0.15):
    rng = np.random.default_rng(seed)
    kind = seed % 4
    x = rng.normal(0, [1, 20, 300, 3][kind], n).round(2)
    if kind == 3:
        x = np.where(rng.random(n) < 0.3, x + 200, x)
    return np.where(rng.random(n) < holes, np.nan, x).tolist()


def test_smooth_matches_the_sequential_rule(hourly):
    series = {f"s{i:03d}": random_series(i, holes=0.0 if i % 2 else 0.1) for i in range(80)}
    # Alternating signals never settle locally: these take the sequential path.
    series["alt"] = [0.0, 100.0] * 60
    series["alt2"] = [math.nan] + [5.0, -80.0, 4.0, -81.0] * 25
    got = collect(C.smooth_spikes(hourly(series), ["site"], "x"))
    for k, x in series.items():
        np.testing.assert_allclose(got[k], sequential_smooth(x), rtol=0, atol=1e-9, equal_nan=True, err_msg=k)


@pytest.mark.parametrize("limit", [2, None])
def test_interpolation_matches_pandas(hourly, limit):
    series = {f"s{i:03d}": random_series(i, holes=[0.2, 0.5, 0.8][i % 3]) for i in range(30)}
    got = collect(C.interpolate(hourly(series), ["site"], "x", limit=limit))
    for k, x in series.items():
        want = pd.Series(x, dtype=float).interpolate(method="linear", limit=limit, limit_direction="both")
        np.testing.assert_allclose(got[k], want, atol=1e-9, equal_nan=True, err_msg=k)


def test_strict_and_causal_interpolation(hourly):
    nan = math.nan
    x = [1.0, nan, nan, 4.0, nan, nan, nan, 8.0, nan]
    strict = collect(C.interpolate(hourly({"a": x}), ["site"], "x", limit=2, strict_short=True))["a"]
    np.testing.assert_allclose(strict, [1, 2, 3, 4, nan, nan, nan, 8, 8], equal_nan=True)
    causal = collect(C.interpolate(hourly({"a": x}), ["site"], "x", limit=2, causal=True))["a"]
    np.testing.assert_allclose(causal, [1, 1, 1, 4, 4, 4, nan, 8, 8], equal_nan=True)


def test_zero_runs(hourly):
    rng = np.random.default_rng(5)
    series = {f"s{i}": np.where(rng.random(100) < 0.5, 0.0, rng.integers(1, 9, 100)).tolist() for i in range(10)}
    got = collect(C.interpolate_zero_runs(hourly(series), ["site"], "x"))
    for k, x in series.items():
        s = pd.Series(x, dtype=float)
        run = (s.ne(0) != s.ne(0).shift()).cumsum()
        short = s.eq(0) & (s.groupby(run).transform("size") <= 2)
        np.testing.assert_allclose(got[k], s.mask(short).interpolate(limit_direction="both"), atol=1e-9)


def test_grid_fills_every_hour_between_global_ends(spark):
    rows = [("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-01 04:00:00", 2.0), ("b", "2024-01-01 00:00:00", 3.0), ("b", "2024-01-01 05:00:00", 4.0)]
    df = spark.createDataFrame(rows, "site string, t string, x double").selectExpr("site", "cast(t as timestamp_ntz) as ts", "x")
    got = collect(C.complete_grid(df, ["site"]))
    nan = math.nan
    np.testing.assert_allclose(got["a"], [nan, 1, nan, nan, 2, nan], equal_nan=True)
    np.testing.assert_allclose(got["b"], [3, nan, nan, nan, nan, 4], equal_nan=True)


def brute_knn(v, k=5):
    v = np.asarray(v, dtype=float)
    out = v.copy()
    for i in range(len(v)):
        for c in np.flatnonzero(np.isnan(v[i])):
            found = []
            for j in range(len(v)):
                both = ~np.isnan(v[i]) & ~np.isnan(v[j])
                if not np.isnan(v[j, c]) and both.any():
                    d = math.sqrt(((v[i, both] - v[j, both]) ** 2).sum() * v.shape[1] / both.sum())
                    found.append((d, j, v[j, c]))
            found.sort()
            near = found[:k]
            if not near:
                out[i, c] = np.nanmean(v[:, c])
            elif any(d == 0 for d, _, _ in near):
                out[i, c] = np.mean([x for d, _, x in near if d == 0])
            else:
                out[i, c] = sum(x / d for d, _, x in near) / sum(1 / d for d, _, _ in near)
    return out


@pytest.mark.parametrize("chunk", [8192, 6])
def test_knn_matches_brute_force(spark, hourly, chunk):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 10, (60, 3)).round(2)
    v[rng.random(v.shape) < 0.25] = np.nan
    v[7] = np.nan
    df = hourly({"a": v[:, 0]}, "p").join(hourly({"a": v[:, 1]}, "q"), ["site", "ts"]).join(hourly({"a": v[:, 2]}, "r"), ["site", "ts"])
    rows = C.knn_impute(df, ["site"], ["p", "q", "r"], chunk_rows=chunk, block_hours=25).orderBy("ts").collect()
    np.testing.assert_allclose([[r.p, r.q, r.r] for r in rows], brute_knn(v), atol=1e-9)


def boxes_of(v, label):
    cut = [v[label == i] for i in range(label.max() + 1)]
    cut = [x for x in cut if len(x)]
    with np.errstate(all="ignore"):
        low = np.array([[np.nanmin(x[:, c]) if (~np.isnan(x[:, c])).any() else np.nan for c in range(v.shape[1])] for x in cut])
        high = np.array([[np.nanmax(x[:, c]) if (~np.isnan(x[:, c])).any() else np.nan for c in range(v.shape[1])] for x in cut])
    return cut, low, high, np.array([(~np.isnan(x)).sum(axis=0) for x in cut]), np.array([len(x) for x in cut])


def test_no_donor_is_nearer_than_its_chunk_bound():
    rng = np.random.default_rng(3)
    v = rng.normal(0, 10, (400, 4)).round(1)
    v[rng.random(v.shape) < 0.3] = np.nan
    cut, low, high, held, size = boxes_of(v, nearest_pivot(v, v[:12]))
    bound, _ = lower_bounds(v, low, high, held == size[:, None])
    for i, chunk in enumerate(cut):
        both = ~np.isnan(v)[:, None, :] & ~np.isnan(chunk)[None, :, :]
        gap = np.where(both, v[:, None, :] - chunk[None, :, :], 0.0) ** 2
        with np.errstate(all="ignore"):
            dist = np.where(both.any(axis=2), np.sqrt(gap.sum(axis=2) * 4 / both.sum(axis=2)), np.inf)
        assert (bound[:, i] <= dist.min(axis=1) + 1e-9).all()


def test_knn_visits_few_chunks_of_separate_regimes():
    rng = np.random.default_rng(4)
    v = np.repeat(np.arange(40) * 100.0, 50)[:, None] + rng.normal(0, 1, (2000, 3))
    t = v[::20].copy()
    t[:, 1] = np.nan
    _, low, high, held, size = boxes_of(v, nearest_pivot(v, v[::50]))
    at, to = visits(t, low, high, held, size, 5)
    assert len(at) == len(t)
    more, _ = visits(t, low, high, held, size, 5, np.full(t.shape, 2.0))
    assert len(more) == 0


def test_knn_kernel_ties_go_to_the_earlier_donor():
    d = np.array([[1.0, 5.0], [1.0, 6.0], [1.0, 7.0], [1.0, np.nan], [0.0, 9.0]])
    r, c, j, dist = nearest(np.array([[1.0, np.nan], [np.nan, np.nan]]), d, 2)
    assert (r.tolist(), c.tolist(), j.tolist(), dist.tolist()) == ([0, 0], [1, 1], [0, 1], [0.0, 0.0])


@pytest.mark.parametrize("scaled", [False, True])
def test_knn_with_columns_that_never_meet(spark, hourly, scaled):
    nan = math.nan
    p, q = [1.0, 2.0, nan, nan, nan, 4.0], [nan, nan, 3.0, 7.0, nan, 5.0]
    df = hourly({"a": p, "b": [1.0] * 6}, "p").join(hourly({"a": q, "b": [nan] * 6}, "q"), ["site", "ts"])
    rows = C.knn_impute(df, ["site"], ["p", "q"], chunk_rows=2, scaled=scaled).orderBy("site", "ts").collect()
    got = [[r.p, r.q] for r in rows[:6]]
    if not scaled:
        np.testing.assert_allclose(got, brute_knn(np.column_stack([p, q])))
    assert got[0][1] == pytest.approx(5.0) and got[2][0] == pytest.approx(4.0)
    assert all(r.p == 1.0 and r.q is None for r in rows[6:])


def test_smooth_takes_alternating_series_of_any_length(hourly):
    series = {"a": [0.0, 100.0] * 700, "b": [float((i * 37) % 101) for i in range(900)]}
    got = collect(C.smooth_spikes(hourly(series), ["site"], "x"))
    for k, x in series.items():
        np.testing.assert_allclose(got[k], sequential_smooth(x), rtol=0, atol=1e-9, equal_nan=True, err_msg=k)


def test_many_series_are_dealt_by_the_size_of_their_grid(spark, monkeypatch):
    """Ten suppliers: some 6,000 rows, but 25,000 on the complete calendar."""
    from headrace.plans import q_features as Q

    sf = "/root/testdata/sf0.001"
    want = Q.supplier_days(spark, sf)
    monkeypatch.setattr(C, "GRID_ROWS", 5000, raising=False)
    got = Q.supplier_days(spark, sf)
    rows = got.groupBy("site").count().collect()
    assert got.rdd.getNumPartitions() >= sum(r["count"] for r in rows) * 0.9 / 5000 and len({r["count"] for r in rows}) == 1
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
