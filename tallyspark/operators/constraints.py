"""Constraints as queries: files do not enforce keys, so violations are looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.schema import STATUS_LENGTH


def duplicate_settlements(settlements: DataFrame) -> DataFrame:
    """Order ids settled more than once."""
    return (
        settlements.groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("settlement_count"))
        .filter(F.col("settlement_count") > 1)
    )


def null_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, null_count) per column, all counted in one pass."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "null_count")


def without_nulls(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that have all of these columns, and the others: together all rows."""
    complete = F.lit(True)
    for name in columns:
        complete = complete & F.col(name).isNotNull()
    return rows.filter(complete), rows.filter(~complete)


def status_length_violations(orders: DataFrame, limit: int = STATUS_LENGTH) -> DataFrame:
    """Orders whose status is longer than the column allows."""
    status_length = F.length("status").cast("long")
    return orders.filter(status_length > limit).select(
        "id", "status", status_length.alias("status_length")
    )
