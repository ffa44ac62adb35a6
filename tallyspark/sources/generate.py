"""Synthetic orders: every value is a hash of the id, so any task can redraw its rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.draws import uniform
from tallyspark.schema import (
    CONFIRMED,
    MAX_AMOUNT,
    MIN_AMOUNT,
    ORDER_DATE,
    ORDERS,
    SELLER_COUNT,
)

SELLER_SEED = 11
AMOUNT_SEED = 23
ROWS_PER_TASK = 16_000_000


def generate_orders(
    spark: SparkSession, count: int, created_at: dt.datetime, first_id: int = 1
) -> DataFrame:
    """``count`` confirmed orders with ids first_id, first_id + 1, …

    Ids ascend through the tasks, so files written from here have disjoint id ranges.
    """
    cores = spark.sparkContext.defaultParallelism
    tasks = max(1, min(count, max(cores, -(-count // ROWS_PER_TASK))))
    ids = spark.range(first_id, first_id + count, 1, tasks)
    key = F.col("id")
    return ids.select(
        key,
        uniform(key, SELLER_SEED, 1, SELLER_COUNT).alias("seller_id"),
        uniform(key, AMOUNT_SEED, MIN_AMOUNT, MAX_AMOUNT).alias("amount"),
        F.lit(CONFIRMED).alias("status"),
        F.lit(ORDER_DATE).alias("order_date"),
        F.lit(created_at.isoformat(" ")).cast("timestamp_ntz").alias("created_at"),
    ).select(ORDERS.names)


def order_count(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count(F.lit(1)).alias("order_count"))


def missing_orders(orders: DataFrame, target: int, created_at: dt.datetime) -> DataFrame:
    """The rows to append so that ``target`` orders exist; none when they already do.

    Only the row count and the highest id come to the driver.
    """
    have = orders.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("id"), F.lit(0)).alias("last_id")
    ).first()
    missing = max(0, target - have["rows"])
    first_id = max(0, have["last_id"]) + 1
    return generate_orders(orders.sparkSession, missing, created_at, first_id)


def top_up_orders(orders: DataFrame, target: int, created_at: dt.datetime) -> DataFrame:
    """The orders topped up to ``target`` rows."""
    return orders.unionByName(missing_orders(orders, target, created_at))
