"""Times the headline queries: python bench.py [--all]

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores. Prints one JSON line;
each time is the median of three runs after a warm-up, the whole result being computed and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from fleetgauge import build_session
from fleetgauge.plans.queries import QUERIES

HEADLINE = [
    "top_queries", "top_queries_latest", "latest_per_instance", "counter_delta", "counter_delta_fleet", "digest_top100",
    "global_variables", "rule_check", "findings_by_category", "rule_run", "duplicate_keys", "index_catalog",
    "assemble_schemas", "correlate_waits", "wait_summary", "wait_totals", "sample_digest_join", "status_numbers",
    "summary_assembly", "schema_sizes", "health_streaks", "all_failing_spans", "poll_outcome", "topology_diff",
    "union_metrics", "write_heavy_indexes",
]


def shuffle_bytes(spark) -> int:
    """Bytes written to shuffles so far by the stages of this session."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(names: list[str], repeats: int = 3) -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds, shuffled = {}, {}
    for name in names:
        run(spark, folder, name)
        before = shuffle_bytes(spark)
        times = [run(spark, folder, name) for _ in range(repeats)]
        seconds[name] = round(statistics.median(times), 3)
        shuffled[name] = (shuffle_bytes(spark) - before) // repeats
        print(f"{name:26s}{seconds[name]:8.3f}s {shuffled[name] / 1e6:9.2f} MB shuffled", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "shuffle_bytes": shuffled, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "spark": spark.version,
    }))


if __name__ == "__main__":
    main(list(QUERIES) if "--all" in sys.argv else HEADLINE)
