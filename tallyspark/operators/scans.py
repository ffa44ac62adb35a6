"""Reads of the orders table: typed, filtered, by id range and whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.schema import CONFIRMED, ORDERS


def typed_orders(rows: DataFrame) -> DataFrame:
    """The declared columns and types; narrows SQL dates and timestamps to local ones."""
    return rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in ORDERS.fields])


def confirmed_scan(orders: DataFrame, ordered: bool = False) -> DataFrame:
    """Orders waiting to be settled. Sorting shuffles the table, so only on request."""
    confirmed = orders.filter(F.col("status") == CONFIRMED)
    return confirmed.orderBy("id") if ordered else confirmed


def id_range_scan(orders: DataFrame, min_id: int, max_id: int) -> DataFrame:
    """Ids min_id..max_id, both inclusive, whatever their status."""
    return orders.filter(F.col("id").between(min_id, max_id))


def full_read(orders: DataFrame, after: int = 0, ordered: bool = False) -> DataFrame:
    """Every order above the cursor once: all keyset pages as a single parallel scan."""
    rows = orders.filter(F.col("id") > after)
    return rows.orderBy("id") if ordered else rows
