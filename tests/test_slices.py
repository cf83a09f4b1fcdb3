import datetime as dt

from test_rollout import SITES, world  # noqa: F401

from headrace.operators import features as E
from headrace.operators import models as M
from headrace.operators import slices as C

T0 = dt.datetime(2024, 1, 1)


def test_histories_equal_filters(spark):
    """Gaps, a series that starts late and one that ends early; origins with days between them."""
    rows = [(s, T0 + dt.timedelta(hours=h), float(h)) for s, hours in (("a", range(0, 120, 5)), ("b", range(60, 70)), ("c", [130])) for h in hours]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz, total double")
    at = [T0 + dt.timedelta(days=d) for d in (0, 2, 3, 5)]
    origins = spark.createDataFrame([(o,) for o in at], "origin timestamp_ntz")
    tagged = [r.asDict() for r in C.known_from(df, origins).collect()]
    assert len(tagged) == sum(t < at[-1] for _, t, _ in rows)
    got = {(r["site"], r["origin"]): r for r in C.history_by_origin(df, ["site"], "total", origins).collect()}
    want = {}
    for o in at:
        for s in "abc":
            past = sorted((t, v) for k, t, v in rows if k == s and t < o)
            assert sorted((r["ts"], r["total"]) for r in tagged if r["site"] == s and r["known_from"] <= o) == past
            if past:
                want[s, o] = past
    assert set(got) == set(want)
    for key, past in want.items():
        r = got[key]
        assert (r["n"], r["first_ts"], r["last_ts"], r["newest"], r["total"]) == (len(past), past[0][0], past[-1][0], past[-1][1], sum(v for _, v in past))


def test_empty_tables(spark):
    df = spark.createDataFrame([("a", T0, 1.0)], "site string, ts timestamp_ntz, total double")
    none = spark.createDataFrame([], "origin timestamp_ntz")
    some = spark.createDataFrame([(T0 + dt.timedelta(days=1),)], "origin timestamp_ntz")
    assert C.known_from(df, none).isEmpty() and C.history_by_origin(df.limit(0), ["site"], "total", some).isEmpty()


def test_first_serving_step_equals_training(world):  # noqa: F811
    names = M.feature_names()
    frame = M.model_frame(world["series"], world["site_dim"])
    got = E.serving_rows(frame, names, world["origins"]).collect()
    assert len(got) == len(SITES) * 2 * 24
    train = {(r["site"], r["ts"]): r for r in frame.collect()}
    for r in (r for r in got if r["h"] == 1):
        t = train[r["site"], r["origin"] - dt.timedelta(hours=1)]
        for n in names:
            assert abs(float(r[n]) - float(t[n] or 0.0)) < 1e-9, n
    # Later steps keep the lags of the last row and move the calendar only.
    moved = {n for n in names if len({r[n] for r in got if r["site"] == "a"}) > 2}
    assert moved <= {n for n in names if n.startswith("target_")}


def test_split_ratios_are_exact(spark):
    """Where a ratio of the length is a whole number, no row is lost to binary fractions."""
    from headrace.operators import splits as P

    lengths = [1, 2, 7, 10, 90, 100, 360, 719, 720, 1440]
    df = spark.createDataFrame([(n,) for n in lengths], "site int").selectExpr("site", "explode(sequence(1, site)) as ts")
    got = {(r["site"], r["split"]): r["count"] for r in P.chronological_split(df, ["site"]).groupBy("site", "split").count().collect()}
    for n in lengths:
        first, second = n * 70 // 100, n * 85 // 100
        assert [got.get((n, s), 0) for s in ("train", "validation", "testing")] == [first, second - first, n - second], n
