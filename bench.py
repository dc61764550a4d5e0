"""Times the headline queries and prints one JSON line.

Every query runs three times into a sink that drops the rows; the median counts,
so neither JVM start nor code generation is measured.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from quorate.plans.queries import registered
from quorate.session import local_session

HEADLINE = (
    "b1_validate", "c1_hits", "c2_team", "d2_extractive", "d3_opinions",
    "e1_agreement", "e2_level_counts", "e3_by_specialty", "e4_outliers", "e5_breakdown",
    "f3_overlaps", "f4_conflicts", "g1_quotes", "g2_corpus", "g4_verdicts",
    "g5_report", "h1_trace", "h2_stages", "h4_orphans", "h5_latency", "h6_barrier",
    "i1_assemble", "i1_assess_documents",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, shuffle_partitions=int(cores))
    queries = registered()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "headline queries, median of three, summed",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cores": int(cores),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
