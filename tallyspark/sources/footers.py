"""Bounds and counts of a stored table from the footers of its files.

Parquet footers hold the least and greatest value of a column and the number of rows. For a
table partitioned by status, the reader of version 2 answers min, max and count by status from
these alone: a task opens footers and reads no column. It applies where an aggregate has no
filter but on the partition column, which is the case for the bounds of a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.schema import ORDERS

#: Settings under which Parquet is read by version 2, and aggregates reach it.
SETTINGS = {
    "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text",
    "spark.sql.parquet.aggregatePushdown": "true",
}

BOUNDS = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("min_id", T.LongType()),
        T.StructField("max_id", T.LongType()),
        T.StructField("row_count", T.LongType()),
    ]
)


@contextmanager
def footer_reads(spark: SparkSession) -> Iterator[None]:
    """The settings, as long as the block runs. They count when a query is run, not when it is
    put together, so run it inside."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_by_status(orders: DataFrame, folder: str) -> None:
    """Orders in one folder for each status, sorted by id so that footers bound narrow spans."""
    sorted_orders = orders.repartitionByRange("status", "id").sortWithinPartitions("status", "id")
    sorted_orders.write.mode("overwrite").partitionBy("status").parquet(folder)


def _by_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(ORDERS).parquet(folder)
    return rows.groupBy("status").agg(
        F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count(F.lit(1)).alias("row_count")
    )


def status_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """(status, min_id, max_id, row_count) of a table by status: one row for each of its few
    statuses, read from the footers when this is called."""
    with footer_reads(spark):
        rows = _by_status(spark, folder).collect()
    return spark.createDataFrame(rows, BOUNDS)
