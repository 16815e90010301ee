"""Times the headline queries (median of a few runs in one warm session) and prints one JSON line.

Set BENCH_SF_DIR for the tables and BENCH_CPUS for the number of local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

HEADLINE = [
    "isize_histogram",
    "mate_pairs",
    "active_pairs",
    "active_coverage",
    "candidate_lengths",
    "data_loglik",
    "window_calls_em",
    "unify_calls",
    "merge_intervals",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from lacuna.plans.catalog import QUERIES
    from lacuna.session import local_session

    spark = local_session(CPUS, "lacuna-bench")
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(REPEATS):
            begin = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name}: {times[name]} s {[round(r, 2) for r in runs]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
