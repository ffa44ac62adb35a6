"""Times the queries and the eight settlement cases; prints one JSON line.

``queries``: seconds per query over BENCH_SF_DIR, best of BENCH_RUNS after one warm-up.
``cases``: each case reading from and writing to Parquet tables of BENCH_CASE_ROWS
generated orders, best of BENCH_RUNS after one warm-up, next to the published rate.
"""

from __future__ import annotations

import json
import os
import time

from tallyspark.plans.cases import CASES, run_case
from tallyspark.queries import QUERIES
from tallyspark.session import local_session, scratch_folder
from tallyspark.sources.fixtures import SETTLED_AT
from tallyspark.sources.generate import generate_orders
from tallyspark.sources.tables import write_version

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
CASE_ROWS = int(os.environ.get("BENCH_CASE_ROWS", "1000000"))

PUBLISHED = {
    "reader-offset": 1_278,
    "reader-zero-offset": 271_444,
    "writer-jpa": 9_497,
    "writer-jdbc-batch": 25_101,
    "insert-identity": 10_638,
    "insert-jdbc-rewrite": 64_433,
    "sequential": 24_794,
    "partitioning": 63_988,
}


def timed(work) -> float:
    started = time.perf_counter()
    work()
    return time.perf_counter() - started


def query_seconds(spark, query) -> float:
    def run():
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()

    run()
    return round(min(timed(run) for _ in range(RUNS)), 3)


def case_results(spark) -> dict:
    results = {}
    for name in CASES:
        # every case starts from confirmed orders, so that a reader finds them all
        tables = scratch_folder(spark, f"bench-{name}")
        write_version(generate_orders(spark, CASE_ROWS, SETTLED_AT), f"{tables}/orders")
        logs = [run_case(spark, name, tables, SETTLED_AT) for _ in range(RUNS + 1)]
        steps = [log.filter("step_name not like '%:%'").first() for log in logs[1:]]
        seconds = min(step["duration_ms"] for step in steps) / 1000
        rate = round(steps[0]["read_count"] / seconds)
        results[name] = {
            "rows": steps[0]["read_count"],
            "sec": seconds,
            "rows_per_sec": rate,
            "published_rows_per_sec": PUBLISHED[name],
            "times_published": round(rate / PUBLISHED[name], 1),
        }
    return results


def main() -> None:
    spark = local_session("bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {name: query_seconds(spark, query) for name, query in QUERIES.items()}
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": CPUS,
        "cases": case_results(spark) if CASE_ROWS else {},
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
