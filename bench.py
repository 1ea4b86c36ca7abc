"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_QUERIES (comma-separated keys), BENCH_RUNS
(timed runs per query after one warm-up run, default 1; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ridership.registry import QUERIES  # noqa: E402
from ridership.session import clear, get_spark  # noqa: E402

HEADLINE = [
    "load_windows",
    "c2_drop_negative_load",
    "c_cleaning_chain",
    "d8_gtfs_version_in_force",
    "e6_headway_flags",
    "f1_trip_level",
    "f2_route_window_rollup",
    "f6_resample_mean",
    "f13_describe",
    "g3_day_ahead_features_route",
    "g3_day_ahead_features_global",
    "h2_class_bounds",
    "i2_asof_backward",
    "i10_disruption_status",
    "j3_cells_crossed",
    "k1_lookback_percentile_4w",
    "l2_stratified_kfold",
    "l9_sliding_sequences",
    "m8_any_day_input",
    "n1_rmse_by_window",
    "n7_threshold_sweep",
    "feature_store",
]


def run_once(spark, key: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    keys = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
        spark__sql__shuffle__partitions=str(2 * cpus),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for key in keys:
        run_once(spark, key, sf_dir)
        times[key] = round(statistics.median(run_once(spark, key, sf_dir) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times}
    print(json.dumps({**line, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    clear()
    spark.stop()


if __name__ == "__main__":
    main()
