"""Runs settlement cases on stored tables: ``python -m tallyspark``."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from tallyspark.operators.runlog import status_report
from tallyspark.plans.cases import CASES, run_case, seed_orders
from tallyspark.schema import (
    COMPLETED,
    FAILED,
    GRID_SIZE,
    INSERT_COUNT,
    JOB_EXECUTIONS,
    STEP_EXECUTIONS,
)
from tallyspark.session import SETTINGS
from tallyspark.sources.tables import append_batch, drop_old_versions, next_batch, read_batches


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallyspark", description=__doc__)
    parser.add_argument("tables", help="folder of the orders and settlements tables")
    parser.add_argument("cases", nargs="*", metavar="case", help=f"default all: {' '.join(CASES)}")
    parser.add_argument("--orders", type=int, default=0, help="generate orders up to this number")
    parser.add_argument("--insert-count", type=int, default=INSERT_COUNT, help="ids the insert cases settle")
    parser.add_argument("--grid", type=int, default=GRID_SIZE, help="ranges of the partitioned case")
    parser.add_argument("--keep", type=int, default=2, help="versions of each table to keep")
    parser.add_argument("--settled-at", type=dt.datetime.fromisoformat, default=None)
    chosen = parser.parse_args(arguments)
    unknown = set(chosen.cases) - set(CASES)
    if unknown:
        parser.error(f"unknown case: {', '.join(sorted(unknown))}")

    builder = SparkSession.builder.appName("tallyspark")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    settled_at = chosen.settled_at or dt.datetime.now()
    if chosen.orders:
        seed_orders(spark, chosen.tables, chosen.orders, settled_at)
    steps = f"{chosen.tables}/steps"
    jobs = f"{chosen.tables}/jobs"
    first = max(next_batch(spark, steps), next_batch(spark, jobs))
    for batch, name in enumerate(chosen.cases or CASES, first):
        status = FAILED
        try:
            log = run_case(
                spark, name, chosen.tables, settled_at, chosen.insert_count, chosen.grid
            )
            append_batch(log, steps, batch)
            status = COMPLETED
        finally:
            # a failed case ends the command, and is on record
            job = spark.createDataFrame([(name, status)], JOB_EXECUTIONS)
            append_batch(job, jobs, batch)
        for table in ("orders", "settlements"):
            drop_old_versions(spark, f"{chosen.tables}/{table}", chosen.keep)
    executions = read_batches(spark, steps, STEP_EXECUTIONS, since=first)
    outcomes = read_batches(spark, jobs, JOB_EXECUTIONS, since=first)
    status_report(executions, outcomes).show(truncate=False)


if __name__ == "__main__":
    main()
