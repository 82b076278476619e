"""Seconds per headline query; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated names, all headline queries without it), BENCH_RUNS.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from sumtrace import registry
from sumtrace.session import local_session

HEADLINE = [f"q{n:02d}" for n in range(1, 23)] + [
    "q20_shipped",
    "prov_terms_q01",
    "prov_terms_q09",
    "audit_jacobian",
    "order_rollup",
    "ref_integrity",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    queries = registry.queries()
    seconds = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        # the first run warms up
        seconds[name] = round(statistics.median(took[1:] or took), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
