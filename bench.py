"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed runs per query (the
median counts, after one warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from typeflow.plans.catalog import queries  # noqa: E402
from typeflow.session import build_session  # noqa: E402

HEADLINE = (
    "q01_typing_speed",
    "q02_session_times",
    "q03_top_sites",
    "q06_site_reach",
    "q09_day_of_week",
    "q11_time_of_day",
    "q17_time_of_day_dense",
    "q20_speed_by_time_of_day",
    "q21_now_stats",
    "q23_active_sessions_by_app",
    "q24_active_sessions_history",
    "q25_active_time_by_app",
    "q32_week_over_week",
    "q35_ingest_batches",
    "q37_inter_key_interval",
    "q40_insights_typing",
)

def seconds(build, spark, sf_dir: str, runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "typeflow-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    times = {name: seconds(registered[name], spark, sf_dir, runs) for name in HEADLINE}
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
