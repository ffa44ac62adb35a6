"""Settling by ranges that commit one by one, with a ledger of what each run has to do.

A run first writes its ledger: the ranges, the version of the orders they were taken from, how
many orders each holds, and hence where its settlement ids begin and which batch it becomes.
Ranges then settle as jobs side by side, and each is audited and published by itself. A range
that fails leaves nothing and stops no other one. Running again finds the ledger unfinished
and settles only the ranges without a published batch, with the ids they were given, whatever
happened to the orders meanwhile. A finished ledger is followed by a new one.
"""

from __future__ import annotations

import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.ids import range_number
from tallyspark.operators.numbering import number_rows
from tallyspark.operators.ranges import range_partitions
from tallyspark.operators.settle import settle_numbered, to_settle
from tallyspark.plans.audited import audited_append
from tallyspark.schema import GRID_SIZE, ORDERS, SETTLEMENTS, STEP_EXECUTIONS
from tallyspark.sources.tables import (
    append_batch,
    current_folder,
    finished_batches,
    highest_id,
    latest_version,
    next_batch,
    read_batches,
    truncate,
    version_folder,
)

#: A range's rows are numbered in buckets of that width.
NUMBER_BITS = 16

LEDGER = T.StructType(
    [
        T.StructField("run", T.LongType()),
        T.StructField("partition_no", T.LongType()),
        T.StructField("min_id", T.LongType()),
        T.StructField("max_id", T.LongType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("ids_before", T.LongType()),
        T.StructField("batch", T.LongType()),
        T.StructField("orders_version", T.LongType()),
    ]
)


class Range(NamedTuple):
    """One range of a ledger."""

    run: int
    partition_no: int
    min_id: int
    max_id: int
    row_count: int
    ids_before: int
    batch: int
    orders_version: int


class Worker(NamedTuple):
    """What came of one range: its rows and its own time, or why it failed."""

    partition_no: int
    rows: int
    elapsed_ms: int
    failure: Exception | None = None

    @property
    def status(self) -> str:
        return "FAILED" if self.failure else "COMPLETED"


class RangesFailed(RuntimeError):
    """Some ranges failed; the others are published. Run again to settle the failed ones."""

    def __init__(self, workers: list[Worker]):
        self.workers = workers
        failed = [w for w in workers if w.failure]
        numbers = ", ".join(str(w.partition_no) for w in failed)
        super().__init__(f"ranges {numbers} failed: {failed[0].failure}")


def _ledger(folder: str) -> str:
    return f"{folder}/ledger"


def _latest(spark: SparkSession, folder: str) -> list[Range]:
    runs = finished_batches(spark, _ledger(folder))
    if not runs:
        return []
    rows = read_batches(spark, _ledger(folder), LEDGER, since=runs[0])
    return sorted(Range(*row) for row in rows.collect())


def open_ranges(spark: SparkSession, settlements: str) -> list[Range]:
    """Ranges of the latest ledger that are not published."""
    folder = current_folder(spark, settlements)
    if folder is None:
        return []
    published = set(finished_batches(spark, folder))
    return [part for part in _latest(spark, folder) if part.batch not in published]


def _plan(spark: SparkSession, tables: str, folder: str, grid: int) -> list[Range]:
    """Writes the next ledger; there is one row for each of the ``grid`` ranges."""
    version = latest_version(spark, f"{tables}/orders")
    orders = _orders(spark, tables, version)
    bounds = {row["partition_no"]: row for row in range_partitions(orders, grid).collect()}
    counts = _counts(orders, list(bounds.values())) if bounds else {}
    runs = finished_batches(spark, _ledger(folder))
    run, first = (runs[0] + 1 if runs else 0), next_batch(spark, folder)
    before, parts = highest_id(spark, folder), []
    for number, row in sorted(bounds.items()):
        rows = counts.get(number, 0)
        parts.append(Range(run, number, row["min_id"], row["max_id"], rows, before, first + number, version))
        before += rows
    append_batch(spark.createDataFrame(parts, LEDGER).coalesce(1), _ledger(folder), run)
    return parts


def _counts(orders: DataFrame, bounds: list[Row]) -> dict[int, int]:
    """Orders of each range, given the bounds of all; the first range has the full width."""
    first = min(bounds, key=lambda row: row["partition_no"])
    low, width = first["min_id"], first["max_id"] - first["min_id"] + 1
    high = max(row["max_id"] for row in bounds)
    number = range_number(F.col("id"), F.lit(low), F.lit(width)).alias("partition_no")
    counted = orders.filter(F.col("id").between(low, high)).groupBy(number).count()
    return {row["partition_no"]: row["count"] for row in counted.collect()}


def _orders(spark: SparkSession, tables: str, version: int) -> DataFrame:
    return read_batches(spark, version_folder(f"{tables}/orders", version), ORDERS)


def settle_range(spark: SparkSession, tables: str, folder: str, part: Range, settled_at: dt.datetime) -> Worker:
    """Settles one range and publishes it."""
    started = time.monotonic()
    orders = _orders(spark, tables, part.orders_version)
    inside = to_settle(orders.filter(F.col("id").between(part.min_id, part.max_id)))
    numbered = number_rows(inside, bits=NUMBER_BITS, repeats="repeated")
    rows = settle_numbered(numbered, settled_at, F.lit(part.ids_before), "repeated")
    audited_append(rows, folder, part.batch, repeats="repeated", expected=part.row_count)
    return Worker(part.partition_no, part.row_count, round((time.monotonic() - started) * 1000))


def settle_by_ranges(
    spark: SparkSession,
    tables: str,
    settled_at: dt.datetime,
    grid: int = GRID_SIZE,
    side_by_side: int = GRID_SIZE,
) -> list[Worker]:
    """Settles what the unfinished ledger has left, or else all orders by a new one.

    Raises RangesFailed if a range fails, once all others are through.
    """
    settlements = f"{tables}/settlements"
    if current_folder(spark, settlements) is None:
        truncate(spark, settlements, SETTLEMENTS)
    folder = current_folder(spark, settlements)
    parts = open_ranges(spark, settlements) or _plan(spark, tables, folder, grid)

    def work(part: Range) -> Worker:
        started = time.monotonic()
        try:
            return settle_range(spark, tables, folder, part, settled_at)
        except Exception as failure:  # noqa: BLE001 - whatever it is, other ranges go on
            elapsed = round((time.monotonic() - started) * 1000)
            return Worker(part.partition_no, 0, elapsed, failure)

    with ThreadPoolExecutor(max(1, min(side_by_side, len(parts)))) as pool:
        workers = list(pool.map(work, parts))
    if any(worker.failure for worker in workers):
        raise RangesFailed(workers)
    return workers


def worker_steps(spark: SparkSession, case: str, workers: list[Worker], elapsed_ms: int) -> DataFrame:
    """The run log of such a run: the master, and each worker with its own time."""
    total = sum(worker.rows for worker in workers)
    log = [(case, "masterStep", total, total, 0, elapsed_ms)]
    log += [
        (case, f"workerStep:partition{w.partition_no}", w.rows, w.rows, 0, w.elapsed_ms) for w in workers
    ]
    return spark.createDataFrame(log, STEP_EXECUTIONS)
