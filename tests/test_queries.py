"""Registered queries against their SQL at the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as entry
from headrace.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation supplier orders lineitem events documents pages".split()
SAMPLE = [
    "naive24_leaderboard", "clean_generation", "clean_gate", "clean_level", "knn_impute", "rolling_stats", "upstream_features", "serving_row",
    "last_known", "bounded_history", "normalize_forecast", "normalize_predictions", "load_outage_plan", "suffix_repeats",
    "fit_shrinkage_bias", "pipeline_order", "tune_saved_blend", "learned_weights", "allocate_with_caps", "reconcile_totals",
    "validate_outage_effect", "forecast_metrics", "error_cdf", "error_quantiles", "head_to_head", "rollout_persistence", "one_step_eval",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or v != v:
        return "~"
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([norm(r[c]) for c in cols]) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(str([norm(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want


def test_every_query_is_registered_once():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 141
    no_sql = set(catalog.QUERIES) - set(sql)
    assert len(no_sql) <= 15, no_sql


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["run_metadata", "pipeline_order", "calibration_report", "load_predictions_union"])
def test_raw_tables_are_read_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") < 5 and "stage-" in plan
