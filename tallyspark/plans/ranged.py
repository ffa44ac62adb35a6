"""Orders stored by ranges of ids, of which an update rewrites only those it touches.

A ranged table is partitioned by the number of 2**bits neighbouring ids. An update finds the
ranges of its keys, reads just these, and puts their next rows down as one complete
``pending`` change before it replaces the ranges by dynamic partition overwrite. Files of
other ranges are neither read nor written and keep their names.

Replacing several ranges is not one step, so a run lost there may leave some of them replaced
and some not. The pending change holds the next rows of all of them: ``finish_pending``
replaces them once more, which gives the same rows, and every update and every read through
``read_ranged`` begins with it. One writer per table is assumed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.ids import bucket
from tallyspark.operators.mutations import settle_orders, upsert_orders
from tallyspark.schema import ORDERS
from tallyspark.session import held
from tallyspark.sources.tables import exists, remove

#: Ids of one range.
RANGE_BITS = 20
RANGE = "id_range"
#: Up to that many touched ranges are named in the scan's filter; more are joined.
NAMED_RANGES = 1_000


def _rows(root: str) -> str:
    return f"{root}/rows"


def _pending(root: str) -> str:
    return f"{root}/pending"


def _ranged(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(RANGE, T.LongType())])


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of one range together and in order, so that a range is few files. A range of many
    rows may be cut into several tasks, as its partition is rebalanced by size."""
    return rows.hint("rebalance", RANGE).sortWithinPartitions(RANGE, "id")


def write_ranged(rows: DataFrame, root: str, bits: int = RANGE_BITS) -> None:
    """Stores all rows anew."""
    remove(rows.sparkSession, _pending(root))
    ranged = _dealt(rows.withColumn(RANGE, bucket(F.col("id"), bits)))
    ranged.write.mode("overwrite").partitionBy(RANGE).parquet(_rows(root))


def _stored(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(_ranged(schema)).parquet(_rows(root))


def finish_pending(spark: SparkSession, root: str, schema: T.StructType = ORDERS) -> bool:
    """Completes an update that was put down, if there is one."""
    if not exists(spark, f"{_pending(root)}/_SUCCESS"):
        return False
    pending = spark.read.schema(_ranged(schema)).parquet(_pending(root))
    writer = _dealt(pending).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(RANGE).parquet(_rows(root))
    remove(spark, _pending(root))
    return True


def read_ranged(spark: SparkSession, root: str, schema: T.StructType = ORDERS) -> DataFrame:
    finish_pending(spark, root, schema)
    return _stored(spark, root, schema).drop(RANGE)


def _touched(stored: DataFrame, ranges: DataFrame) -> DataFrame:
    """Stored rows of these ranges; only their folders are read."""
    some = [row[RANGE] for row in ranges.limit(NAMED_RANGES + 1).collect()]
    if len(some) <= NAMED_RANGES:
        return stored.filter(F.col(RANGE).isin(some))
    return stored.join(ranges, RANGE, "left_semi")


def update_ranges(
    spark: SparkSession,
    root: str,
    ids: DataFrame,
    change: Callable[[DataFrame], DataFrame],
    bits: int = RANGE_BITS,
    schema: T.StructType = ORDERS,
) -> None:
    """Replaces the ranges that hold any of ``ids`` by what ``change`` makes of their rows.

    ``change`` gets the rows of the touched ranges and returns their next rows; it neither
    removes an id nor adds one outside of these ranges.
    """
    finish_pending(spark, root, schema)
    remove(spark, _pending(root))
    ranges = ids.filter(F.col("id").isNotNull()).select(bucket(F.col("id"), bits).alias(RANGE)).distinct()
    with held(ranges, "touched") as touched:
        rows = _touched(_stored(spark, root, schema), touched).select(schema.names)
        after = change(rows).select(schema.names).withColumn(RANGE, bucket(F.col("id"), bits))
        after.write.parquet(_pending(root))
    finish_pending(spark, root, schema)


def settle_in_place(
    spark: SparkSession, root: str, keys: DataFrame, key: str = "order_id", bits: int = RANGE_BITS
) -> None:
    """``settle_orders`` on a ranged table."""
    ids = keys.select(F.col(key).alias("id"))
    update_ranges(spark, root, ids, lambda rows: settle_orders(rows, ids, "id"), bits)


def upsert_in_place(
    spark: SparkSession,
    root: str,
    incoming: DataFrame,
    sequence: str | None = None,
    bits: int = RANGE_BITS,
) -> None:
    """``upsert_orders`` on a ranged table; new ids may open new ranges."""
    ids = incoming.select("id")
    update_ranges(spark, root, ids, lambda rows: upsert_orders(rows, incoming, sequence), bits)
