"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
Each query runs once to warm up and then $BENCH_RUNS times (default 3); the
median counts.  Results go to the `noop` sink, so every row is computed.  The Spark jobs
of the last run are printed beside the seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from gaugeline import catalog
from gaugeline.session import build_session, scope

HEADLINE = [
    "record_outliers", "record_outliers_in_arrays", "cf_leaves", "cf_online_outlier",
    "consecutive_alerts", "rolling_history_z", "detection_trend", "quality_summary",
    "dbscan_1d", "single_link_1d", "silhouette", "adaptive_eps", "kmeans_fit",
    "evaluate_clusters", "cf_merge_cluster", "stream_cf_leaves", "stream_cf_outlier",
    "eps_neighbors", "knn_distance_vectors", "dbscan", "cf_compact",
]
# Many small jobs: timed once after the warm-up.
ONCE = ("stream_cf_leaves", "stream_cf_outlier", "dbscan", "cf_compact")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")

    context, jobs = spark.sparkContext, {}

    def once(name: str) -> float:
        context.setJobGroup(group := f"{name}-{time.time_ns()}", name)
        start = time.perf_counter()
        with scope(spark):
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        jobs[name] = len(context.statusTracker().getJobIdsForGroup(group))
        return took

    seconds = {}
    for name in names:
        once(name)
        repeat = 1 if name in ONCE else runs
        seconds[name] = round(statistics.median(once(name) for _ in range(repeat)), 3)
        print(f"{name}: {seconds[name]} s, {jobs[name]} jobs", file=sys.stderr)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "jobs": jobs, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
