"""Headline timings in a warm JVM: all queries run once, then the median of three runs, to a no-op sink.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores,
``BENCH_QUERIES`` (comma list) narrows the set.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_matches_per_site", "keyword_scan_matches", "keyword_scan_context", "ex4_main_text",
    "pr5_candidate_reasons", "sc10_explanation", "scored_scan_matches", "snk1_insert_if_absent",
    "snk3_keyed_update", "ag1_kpis", "ag5_run_metrics", "tl1_top_terms", "tl2_rank_projects",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINE)

    from careerlens.catalog import QUERIES
    from careerlens.session import local_session

    spark = local_session(cpus, "bench", partitions=int(cpus))

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in chosen:
        run(name)
    times = {name: round(statistics.median(run(name) for _ in range(3)), 3) for name in chosen}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "cores": cpus, "spark": spark.version, "shuffle_partitions": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
