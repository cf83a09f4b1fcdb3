import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from headrace.functions.rollout_kernel import fill_units
from headrace.operators import outage as I


def rounds(total, weights, caps):
    """Step-by-step proportional filling, leftovers by headroom."""
    total = min(max(total, 0.0), sum(caps))
    alloc, active = [0.0] * len(caps), list(range(len(caps)))
    for _ in range(len(caps) + 1):
        rest = total - sum(alloc)
        if rest <= 1e-9 or not active:
            break
        w = {i: weights[i] for i in active}
        if sum(w.values()) <= 0:
            w = {i: caps[i] for i in active}
        s = sum(w.values())
        full = set()
        for i in active:
            want, room = w[i] / s * rest, caps[i] - alloc[i]
            if want >= room:
                full.add(i)
            alloc[i] += min(want, room)
        active = [i for i in active if i not in full and caps[i] - alloc[i] > 1e-9]
    return alloc


unit = st.tuples(st.sampled_from([0.0, 0.05, 0.2, 0.5, 1.0]), st.sampled_from([5.0, 27.5, 50.0, 60.0]))


@settings(max_examples=200, deadline=None)
@given(st.lists(unit, min_size=1, max_size=6), st.floats(0, 400))
def test_kernel_filling_matches_rounds(units, total):
    w, c = [u[0] for u in units], [u[1] for u in units]
    got = fill_units(np.array([total]), np.array([w]), np.array([c]))[0]
    np.testing.assert_allclose(got, rounds(total, w, c), atol=1e-6)


def test_closed_form_matches_rounds(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(300):
        n = int(rng.integers(1, 7))
        w = rng.choice([0.0, 0.1, 0.3, 1.0], n)
        c = rng.choice([5.0, 27.5, 50.0], n)
        for i in range(n):
            rows.append((f"s{g}", f"unit{i}", pd.Timestamp("2024-01-01"), float(c[i]), float(w[i]), float(g)))
    pdf = pd.DataFrame(rows, columns=["site", "unit", "ts", "capacity", "weight", "total"])
    got = I.allocate_with_caps(spark.createDataFrame(pdf)).toPandas()
    for _, part in got.sort_values("unit").groupby("site"):
        want = rounds(part["total"].iloc[0], part["weight"].tolist(), part["capacity"].tolist())
        np.testing.assert_allclose(part["mw"], want, atol=1e-6)


def test_outage_loses_output_unless_reallocated(spark):
    rows = [("a", "unit1", 50.0, 0.5, 60.0, 0), ("a", "unit2", 50.0, 0.5, 60.0, 1)]
    df = spark.createDataFrame(rows, "site string, unit string, capacity double, weight double, total double, available int").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp_ntz")
    )
    lost = {r.unit: r.mw for r in I.apply_outage(df).collect()}
    assert lost == {"unit1": 0.0, "unit2": 30.0}
    moved = {r.unit: r.mw for r in I.apply_outage(df, reallocate=True).collect()}
    assert moved == {"unit1": 0.0, "unit2": 50.0}


def test_violations_are_found(spark):
    t = "2024-01-01 0{}:00:00"
    units = spark.createDataFrame(
        [("a", "unit1", t.format(0), 3.0, 0), ("a", "unit1", t.format(1), 0.0, 1), ("a", "unit2", t.format(0), 3.0, 1), ("a", "unit2", t.format(1), 4.0, 1)],
        "site string, unit string, t string, mw double, available int",
    ).selectExpr("site", "unit", "cast(t as timestamp_ntz) as ts", "mw", "available")
    totals = spark.createDataFrame([("a", t.format(0), 6.0), ("a", t.format(1), 5.0)], "site string, t string, total double").selectExpr("site", "cast(t as timestamp_ntz) as ts", "total")
    cascade = totals.groupBy("ts").agg((F.sum("total") + 1).alias("total"))
    kinds = sorted(r.kind for r in I.validate_outage_effect(units, totals, cascade).collect())
    assert kinds == ["cascade_total_mismatch", "cascade_total_mismatch", "generation_while_out", "identical_active_units", "site_total_mismatch", "zero_after_return"]


def test_summary_without_outages_names_no_site(spark):
    rows = [("mon", "b", "unit1", 0), ("mon", "a", "unit1", 0), ("mon", "a", "unit2", 1), ("tue", "a", "unit1", 1), ("tue", "b", "unit1", None)]
    plan = spark.createDataFrame(rows, "d string, site string, unit string, available int")
    got = {r.d: (r.unavailable_hours, r.available_hours, r.affected_units, r.affected_sites, r.sites) for r in I.outage_summary(plan, ("d",)).collect()}
    assert got == {"mon": (2, 1, 2, 2, "a,b"), "tue": (0, 2, 0, 0, None)}
    assert I.outage_summary(plan.where("d = 'tue'")).first()["sites"] is None
