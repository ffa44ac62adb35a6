"""Single pages in id order.

A plain ``orderBy.limit`` keeps the top rows of every input split and merges them all in
one task, and a deep offset pulls every skipped row through it. Both pages here first
locate the ids the page lies in, then read only those: the bounds reach the Parquet reader
as row-group filters, so on a table clustered by id a page costs a few row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.ids import bucket_end, bucket_start
from tallyspark.operators.numbering import bucket_offsets
from tallyspark.schema import CHUNK_SIZE

# Finer buckets than for numbering: what they hold beside the page passes through a
# top-k heap instead of a sort that spills.
PAGE_BITS = 16
HIGHEST_ID = 2**63 - 1


def keyset_page(
    orders: DataFrame,
    after: int,
    size: int = CHUNK_SIZE,
    upto: int | None = None,
    bits: int = PAGE_BITS,
) -> DataFrame:
    """First ``size`` rows with id above ``after`` (and at most ``upto``).

    Looks at the 2**bits ids behind the cursor, and at sixteen times as many as long as they
    hold no full page. Each look is a job that stops at ``size`` rows; the number of rows
    beyond the window does not matter. Bounds that lie within one window need no look.
    """
    last = HIGHEST_ID if upto is None else upto
    rows = orders.filter(F.col("id") > after)
    width = 1 << bits
    while after + width < last:
        near = rows.filter(F.col("id") <= after + width)
        if near.select("id").limit(size).count() == size:
            return near.orderBy("id").limit(size)
        width <<= 4
    return rows.filter(F.col("id") <= last).orderBy("id").limit(size)


def offset_page(
    rows: DataFrame, page: int, size: int = CHUNK_SIZE, bits: int = PAGE_BITS
) -> DataFrame:
    """Page ``page`` (from 0) of ``size`` rows; empty past the end.

    Locating the page is a job of its own that brings three numbers to the driver.
    """
    low, high = page * size, page * size + size
    touched = bucket_offsets(rows.select("id"), bits=bits).filter(
        (F.col("rows_before") < high) & (F.col("rows_before") + F.col("bucket_rows") > low)
    )
    span = touched.agg(
        bucket_start(F.min("bucket"), bits).alias("first_id"),
        bucket_end(F.max("bucket"), bits).alias("last_id"),
        F.min("rows_before").alias("skipped"),
    ).first()
    if span["first_id"] is None:
        return rows.filter(F.lit(False))
    # less than 2**bits rows to skip, at most size + 2 * 2**bits rows to sort
    near = rows.filter(F.col("id").between(span["first_id"], span["last_id"]))
    return near.orderBy("id").offset(low - span["skipped"]).limit(size)
