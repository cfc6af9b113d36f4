"""Time the headline queries and print one JSON line.

Each query is planned and run ``RUNS`` times over the whole tables into a sink that discards rows; the fastest
run counts. The first run of a query pays for code generation and class loading, which a long-lived session
pays once.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardwatch.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "a4_device_health",
    "a5_room_presence",
    "a10_room_occupancy",
    "a10_room_occupancy_retained",
    "a11_multi_window",
    "f2_fall_dedup",
    "f3_fall_outcomes",
    "f7_reconcile",
    "m1_ingest_counters",
    "m2_fall_counters",
    "m4_alarm_p95",
    "o1_device_order",
    "r1_state_as_of",
    "s3_event_log",
    "v8_rejects_by_reason",
    "t1_stream_validate",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(RUNS):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(min(times), 3)
        print(name, [round(t, 3) for t in times], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
