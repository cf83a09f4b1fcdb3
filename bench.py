"""Headline queries, one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES select the run."""

import json
import os
import time

from headrace.plans import catalog
from headrace.session import local_session

HEADLINE = [
    "naive24_leaderboard", "clean_generation", "knn_impute", "rolling_stats", "unit_lags_shares", "upstream_features",
    "many_series_leaderboard", "forecast_metrics", "error_cdf", "error_quantiles", "fit_shrinkage_bias",
    "fit_bin_calibration", "pipeline_order", "learned_weights", "apply_outage", "last_known", "write_panel",
    "ffill_labels", "rollout_persistence", "rolling_backtest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, "headrace-bench")
    # Start the JVM paths and the Python workers once; queries are then timed alone.
    catalog.QUERIES["persistence"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(cpus * 4).repartition(cpus).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
