"""The eight settlement cases as jobs over stored tables.

A job reads the orders table, writes its outputs and returns its run log. Counters are
observed within the writing job itself, so nothing is read again just to be counted.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from functools import partial
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.mutations import reset_orders
from tallyspark.operators.numbering import number_rows
from tallyspark.operators.ranges import assign_ranges
from tallyspark.operators.scans import confirmed_scan, full_read, id_range_scan
from tallyspark.operators.settle import settle_numbered, to_settle
from tallyspark.plans.audited import audited_append
from tallyspark.plans.ledger import settle_by_ranges, worker_steps
from tallyspark.schema import (
    CONFIRMED,
    GRID_SIZE,
    INSERT_COUNT,
    ORDERS,
    SETTLED,
    SETTLEMENTS,
    STEP_EXECUTIONS,
)
from tallyspark.sources.generate import missing_orders
from tallyspark.sources.tables import (
    append_rows,
    current_folder,
    next_batch,
    read_table,
    truncate,
    write_version,
)


class Case(NamedTuple):
    """``reads`` are the orders it reads; ``inserts`` and ``updates`` say which tables change,
    ``grid`` into how many ranges it is split."""

    reads: Callable[[DataFrame], DataFrame]
    inserts: bool = False
    updates: bool = False
    grid: int = 0


def _first_ids(orders: DataFrame, count: int = INSERT_COUNT) -> DataFrame:
    return id_range_scan(orders, 1, count)


#: A million dense ids are sixteen buckets of that width, so numbering them is sixteen tasks.
CASE_BITS = 16

# The case names. Pairs that differ only in how a database driver batches
# its statements are one and the same Spark job.
CASES = {
    "reader-offset": Case(confirmed_scan),
    "reader-zero-offset": Case(full_read),
    "writer-jpa": Case(full_read, updates=True),
    "writer-jdbc-batch": Case(full_read, inserts=True, updates=True),
    "insert-identity": Case(_first_ids, inserts=True),
    "insert-jdbc-rewrite": Case(_first_ids, inserts=True),
    "sequential": Case(full_read, inserts=True, updates=True),
    "partitioning": Case(assign_ranges, inserts=True, updates=True, grid=GRID_SIZE),
}


def seed_orders(spark: SparkSession, tables: str, target: int, created_at: dt.datetime) -> None:
    """Appends generated orders until ``tables``/orders holds ``target`` of them."""
    root = f"{tables}/orders"
    missing = missing_orders(read_table(spark, root, ORDERS), target, created_at)
    append_rows(missing, root)


def reset_tables(spark: SparkSession, tables: str) -> None:
    """No settlements, and every order confirmed. Orders are rewritten only if one is not;
    the check skips row groups that hold nothing but confirmed ones."""
    truncate(spark, f"{tables}/settlements", SETTLEMENTS)
    orders = read_table(spark, f"{tables}/orders", ORDERS)
    if not orders.filter(F.col("status") != CONFIRMED).isEmpty():
        write_version(reset_orders(orders), f"{tables}/orders")


def settle_read_orders(orders: DataFrame, case: Case) -> DataFrame:
    """All orders, the ones the case settles marked so.

    The key set is the scan itself, so the update needs no join: a case reads every order
    above the cursor, or with ranges all of the confirmed ones.
    """
    read = F.col("status") == CONFIRMED if case.grid else F.col("id") > 0
    status = F.when(read, F.lit(SETTLED)).otherwise(F.col("status"))
    return orders.withColumn("status", status)


def run_case(
    spark: SparkSession,
    name: str,
    tables: str,
    settled_at: dt.datetime,
    insert_count: int = INSERT_COUNT,
    grid: int = GRID_SIZE,
) -> DataFrame:
    """Runs a case on ``tables``/orders and returns its run log.

    ``insert_count`` is the highest id that the insert cases settle, ``grid`` the number of
    ranges of the partitioned one.
    Writing cases start from reset tables, which is not part of the time taken.
    Settlements are appended to the emptied table, updated orders are its next version.
    Settlements are written first and decide what is settled, so a job lost between the
    two writes is completed by running it again.
    """
    case = CASES[name]
    if case.reads is _first_ids:
        case = case._replace(reads=partial(_first_ids, count=insert_count))
    if case.grid:
        case = case._replace(grid=grid)
    if case.inserts or case.updates:
        reset_tables(spark, tables)
    orders = read_table(spark, f"{tables}/orders", ORDERS)
    counter = F.count(F.lit(1)).alias("rows")
    seen = Observation()

    started = time.monotonic()
    if case.grid:
        workers = settle_by_ranges(spark, tables, settled_at, grid, side_by_side=grid)
        write_version(settle_read_orders(orders, case), f"{tables}/orders")
        return worker_steps(spark, name, workers, round((time.monotonic() - started) * 1000))
    if case.inserts:
        numbered = number_rows(to_settle(case.reads(orders)), bits=CASE_BITS, repeats="repeated").observe(seen, counter)
        folder = current_folder(spark, f"{tables}/settlements")
        rows = settle_numbered(numbered, settled_at, None, "repeated")
        audited_append(rows, folder, next_batch(spark, folder), repeats="repeated")
        if case.updates:
            write_version(settle_read_orders(orders, case), f"{tables}/orders")
    elif case.updates:
        read = F.count_if(F.col("status") == SETTLED).alias("rows")
        updated = settle_read_orders(orders, case).observe(seen, read)
        write_version(updated, f"{tables}/orders")
    else:
        rows = case.reads(orders).observe(seen, counter)
        rows.write.format("noop").mode("overwrite").save()
    elapsed = round((time.monotonic() - started) * 1000)
    rows = seen.get["rows"]
    return spark.createDataFrame([(name, "step", rows, rows, 0, elapsed)], STEP_EXECUTIONS)
