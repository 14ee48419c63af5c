"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; its median includes building, planning and running it into
Spark's no-op sink. ``naive`` times the join-chain shapes of the same two products for comparison.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "cohort_encounters",
    "indicator_days_condition",
    "measure_days",
    "measure_flags",
    "dose_facts",
    "day_facts",
    "episode_flag",
    "person_summary",
    "topk_matrix",
    "topk_page_days",
    "lookback_rows",
    "mention_concept_rates",
    "mention_pivot",
    "split_exact",
    "seq_scaled",
    "seq_resampled",
    "binary_metrics",
]


def median_seconds(fn, spark, root: str, runs: int) -> float:
    taken = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        fn(spark, root).write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken[1:]), 3)


def main() -> None:
    from longfeat.session import local_session
    from workload.naive import NAIVE
    from workload.queries import QUERIES

    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = sys.argv[1:]
    spark = local_session(cores, app="bench")
    pick = lambda names: [n for n in names if not only or n in only]
    times = {n: median_seconds(QUERIES[n], spark, root, runs) for n in pick(HEADLINE)}
    naive = {n: median_seconds(NAIVE[n], spark, root, runs) for n in pick(NAIVE)}
    spark.stop()
    result = {
        "metric": "headline queries, sum of medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "naive": naive,
        "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
        "cpus": cores,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
