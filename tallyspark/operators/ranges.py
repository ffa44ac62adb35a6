"""Equal-width id ranges over the confirmed orders.

Bounds come from confirmed orders only, while a range holds every status inside its
bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.ids import range_label, range_number, range_width
from tallyspark.functions.money import fee
from tallyspark.operators.scans import confirmed_scan
from tallyspark.schema import GRID_SIZE


def confirmed_bounds(orders: DataFrame) -> DataFrame:
    """One row; both bounds are null when nothing is confirmed."""
    return confirmed_scan(orders).agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def range_partitions(orders: DataFrame, grid: int = GRID_SIZE) -> DataFrame:
    """The ``grid`` ranges, inclusive on both ends; none without confirmed orders.

    Trailing ranges may come out inverted and then select nothing.
    """
    width = range_width(F.col("min_id"), F.col("max_id"), grid)
    number = F.col("partition_no")
    start = F.col("min_id") + number * F.col("width")
    return (
        confirmed_bounds(orders)
        .filter(F.col("min_id").isNotNull())
        .withColumn("width", width)
        .withColumn("partition_no", F.explode(F.sequence(F.lit(0), F.lit(grid - 1).cast("long"))))
        .select(
            number,
            range_label(number).alias("label"),
            start.alias("min_id"),
            F.least(start + F.col("width") - 1, F.col("max_id")).alias("max_id"),
        )
    )


def assign_ranges(orders: DataFrame, grid: int = GRID_SIZE) -> DataFrame:
    """Orders inside the confirmed bounds, with their ``partition_no``.

    The two bounds are read first and become literals: rows are neither joined nor
    shuffled, and files outside the bounds, such as those settled long ago, are skipped.
    """
    low, high = confirmed_bounds(orders).first()
    if low is None:
        return orders.filter(F.lit(False)).withColumn("partition_no", F.lit(0).cast("long"))
    width = (high - low) // grid + 1
    return orders.filter(F.col("id").between(low, high)).withColumn(
        "partition_no", range_number(F.col("id"), F.lit(low), F.lit(width))
    )


def partition_stats(orders: DataFrame, grid: int = GRID_SIZE) -> DataFrame:
    """Rows and money per range that holds any."""
    return (
        assign_ranges(orders, grid)
        .groupBy("partition_no")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
            F.sum("amount").alias("sum_amount"),
            F.sum(fee(F.col("amount"))).alias("sum_fee"),
        )
        .withColumn("label", range_label(F.col("partition_no")))
    )
