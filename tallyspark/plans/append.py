"""Settling what is new: the repeatable form of the insert, for tables that grow."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyspark.operators.mutations import settle_orders
from tallyspark.operators.numbering import BUCKET_BITS
from tallyspark.operators.scans import full_read
from tallyspark.operators.settle import numbered_settlements, to_settle, unsettled_orders
from tallyspark.plans.audited import audited_append
from tallyspark.schema import ORDERS, SETTLEMENTS
from tallyspark.session import held
from tallyspark.sources.tables import (
    current_folder,
    highest_id,
    latest_version,
    next_batch,
    read_batches,
    read_table,
    remove,
    truncate,
    version_folder,
)
from tallyspark.streaming.incremental import start_settling

#: Folder of the stream's batches inside a version of the settlements.
ARRIVED = "arrived"


def _settlements_folder(spark: SparkSession, tables: str) -> str:
    root = f"{tables}/settlements"
    return version_folder(root, latest_version(spark, root))


def appended_settlements(spark: SparkSession, tables: str) -> DataFrame:
    """The one record of what is settled, by cases, appends or the stream."""
    arrived = f"{_settlements_folder(spark, tables)}/{ARRIVED}"
    stored = read_table(spark, f"{tables}/settlements", SETTLEMENTS)
    return stored.unionByName(read_batches(spark, arrived, SETTLEMENTS))


def current_orders(spark: SparkSession, tables: str) -> DataFrame:
    """The stored orders with the status their settlements imply. Nothing is rewritten to
    settle an order; write this as a new version when a snapshot is wanted."""
    orders = read_table(spark, f"{tables}/orders", ORDERS)
    return settle_orders(orders, appended_settlements(spark, tables))


def append_new_settlements(
    spark: SparkSession, tables: str, settled_at: dt.datetime, bits: int = BUCKET_BITS
) -> int:
    """Settles the orders not settled yet as one more batch and returns its number.

    Numbering reads its input twice, so the unsettled orders are put down first and the join
    with all settlements runs only once. A lost run is repeated by calling again: whatever it
    had appended is then settled already. An order that the table holds twice, or without a
    value, fails the append (``plans.audited``) and leaves nothing visible.
    """
    root = f"{tables}/settlements"
    folder = current_folder(spark, root)
    if folder is None:
        folder = version_folder(root, 0)
        remove(spark, folder)
    orders = to_settle(full_read(read_table(spark, f"{tables}/orders", ORDERS)))
    highest = max(highest_id(spark, folder), highest_id(spark, f"{folder}/{ARRIVED}"))
    with held(unsettled_orders(orders, appended_settlements(spark, tables)), "unsettled") as unsettled:
        rows = numbered_settlements(unsettled, settled_at, F.lit(highest), bits, repeats="repeated")
        batch = next_batch(spark, folder)
        audited_append(rows, folder, batch, repeats="repeated")
        return batch


def settle_stream(
    orders: DataFrame, tables: str, checkpoint: str, settled_at: dt.datetime
) -> StreamingQuery:
    """Settles a stream of orders into the settlements of ``tables`` and stops when all is read.

    What cases and appends have settled is not settled again. A reset during a run is not
    foreseen; after one, the next run goes on with new files, and ``append_new_settlements``
    settles the orders of earlier ones.
    """
    spark = orders.sparkSession
    if latest_version(spark, f"{tables}/settlements") < 0:
        truncate(spark, f"{tables}/settlements", SETTLEMENTS)
    folder = _settlements_folder(spark, tables)
    return start_settling(orders, f"{folder}/{ARRIVED}", checkpoint, settled_at, beside=folder)
