"""The settlement itself: one narrow projection, so it runs inside the scan's stage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import fee, net_amount
from tallyspark.operators.numbering import BUCKET_BITS, number_rows
from tallyspark.operators.ranges import assign_ranges
from tallyspark.operators.scans import full_read, id_range_scan
from tallyspark.schema import CONFIRMED, GRID_SIZE, INSERT_COUNT, SETTLED, SETTLEMENTS
from tallyspark.session import put_down


def to_settle(orders: DataFrame, *keep: str) -> DataFrame:
    """The columns a settlement is computed from; ``keep`` passes others through."""
    return orders.select("id", "seller_id", "amount", *keep)


def settlement_projection(orders: DataFrame, *keep: str) -> DataFrame:
    """What each order settles to; ``keep`` passes further order columns through."""
    amount = F.col("amount")
    return orders.select(
        F.col("id").alias("order_id"),
        "seller_id",
        "amount",
        fee(amount).alias("fee"),
        net_amount(amount).alias("net_amount"),
        *keep,
    )


def stamp(rows: DataFrame, settled_at: dt.datetime) -> DataFrame:
    """One moment for the whole run, given by the caller, so reruns agree."""
    return rows.withColumn("settled_at", F.lit(settled_at.isoformat(" ")).cast("timestamp_ntz"))


def settle_status(orders: DataFrame) -> DataFrame:
    """Every order above the cursor, settled; writes no settlements."""
    return full_read(orders).withColumn("status", F.lit(SETTLED))


def settle_full(orders: DataFrame, settled_at: dt.datetime) -> DataFrame:
    """Every order above the cursor with its settlement and resulting status."""
    settled = stamp(settlement_projection(full_read(orders)), settled_at)
    return settled.withColumn("order_status", F.lit(SETTLED))


def settle_bounded(
    orders: DataFrame, settled_at: dt.datetime, count: int = INSERT_COUNT
) -> DataFrame:
    """Settlements of ids 1..count only inserted: the orders keep their status."""
    settled = stamp(settlement_projection(id_range_scan(orders, 1, count)), settled_at)
    return settled.withColumn("order_status", F.lit(CONFIRMED))


def settle_ranged(
    orders: DataFrame, settled_at: dt.datetime, grid: int = GRID_SIZE
) -> DataFrame:
    """As ``settle_full`` but within the confirmed bounds and with the range of each order."""
    ranged = settlement_projection(assign_ranges(orders, grid), "partition_no")
    return stamp(ranged, settled_at).withColumn("order_status", F.lit(SETTLED))


def unsettled_orders(orders: DataFrame, settlements: DataFrame) -> DataFrame:
    """Orders no settlement refers to.

    Keys are made distinct first: a repeated key then collapses before the shuffle. AQE turns
    the join into a broadcast when the keys prove small at run time.
    """
    settled = settlements.select(F.col("order_id").alias("id"))
    return orders.join(settled.distinct(), "id", "left_anti")


def settled_among(orders: DataFrame, settlements: DataFrame) -> DataFrame:
    """The ids of ``orders`` that a settlement refers to, for few orders and many settlements.

    Arriving ids reduce the settlements, not the other way round: small ones are broadcast,
    more of them become a Bloom filter that settlements pass before they shuffle. The bound
    on ids excludes nothing; a filter is only built from a side that has a condition.
    """
    lowest = -(2**63)
    arriving = orders.filter(F.col("id") >= lowest).select(F.col("id").alias("order_id"))
    return settlements.select("order_id").join(arriving, "order_id", "left_semi")


def newly_arrived(orders: DataFrame, settlements: DataFrame) -> DataFrame:
    """As ``unsettled_orders``, moving rows by the number of arrivals and not of settlements."""
    settled = settled_among(orders, settlements).select(F.col("order_id").alias("id"))
    return orders.join(settled, "id", "left_anti")


def settle_numbered(
    orders: DataFrame, settled_at: dt.datetime, highest: Column | None = None, *keep: str
) -> DataFrame:
    """Settlements of orders that have a ``row_no``: their ids go on from ``highest``."""
    number = F.col("row_no") if highest is None else highest + F.col("row_no")
    facts = stamp(settlement_projection(orders, "row_no", *keep), settled_at)
    return facts.withColumn("id", number).select(*SETTLEMENTS.names, *keep)


def numbered_settlements(
    orders: DataFrame,
    settled_at: dt.datetime,
    highest: Column,
    bits: int = BUCKET_BITS,
    repeats: str | None = None,
) -> DataFrame:
    """Settlements of ``orders`` with ids going on from ``highest`` in order of their ids.

    Numbering shuffles only what a settlement is computed from; the rest is added behind.
    ``repeats`` names a column to tell orders that come up again.
    """
    numbered = number_rows(to_settle(orders), bits=bits, repeats=repeats)
    return settle_numbered(numbered, settled_at, highest, *([repeats] if repeats else []))


def new_settlements(
    orders: DataFrame,
    settlements: DataFrame,
    settled_at: dt.datetime,
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """Rows to append: orders not settled yet, with ids going on from the highest one.

    Numbering reads its input twice, so the unsettled orders are written to the shared
    scratch folder first, a job of its own, and the join with all settlements runs once.
    """
    highest = settlements.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    unsettled = put_down(unsettled_orders(to_settle(orders), settlements), "unsettled")
    return numbered_settlements(unsettled, settled_at, highest, bits)


def insert_settlements(
    orders: DataFrame,
    settlements: DataFrame,
    settled_at: dt.datetime,
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """The settlements after the append. Inserting the same orders again adds nothing."""
    return settlements.select(SETTLEMENTS.names).unionByName(
        new_settlements(orders, settlements, settled_at, bits)
    )
