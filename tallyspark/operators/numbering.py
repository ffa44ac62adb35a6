"""Dense numbering in id order without a global sort.

Ids fall into buckets of 2**bits ids. A first pass over the id column alone counts each
bucket and adds the counts up; a second numbers rows inside their bucket. No step holds
more than a bounded number of rows, whatever the id distribution:

* a bucket holds at most 2**bits rows, because ids are unique;
* the at most 2**(64 - bits) buckets are added up in two levels: inside groups of buckets,
  one task each, and across the groups. Both levels get half of the remaining bits, so a
  task adds up at most 2**22 numbers for the default bits.

The rows shuffle once, by bucket; the offsets join uses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.ids import bucket
from tallyspark.schema import CHUNK_SIZE

BUCKET_BITS = 20


def _present(key: str) -> F.Column:
    """The key, or an error where there is none: such a row could not be numbered."""
    return F.coalesce(F.col(key), F.raise_error(F.lit(f"{key} is null")).cast("long"))


def _before(window) -> F.Column:
    return F.coalesce(F.sum("bucket_rows").over(window), F.lit(0))


def bucket_offsets(rows: DataFrame, key: str = "id", bits: int = BUCKET_BITS) -> DataFrame:
    """(bucket, bucket_rows, rows_before) for every non-empty bucket of ids."""
    group_bits = (64 - bits) // 2
    counts = (
        rows.groupBy(bucket(_present(key), bits).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("bucket_rows"))
        .withColumn("bucket_group", bucket(F.col("bucket"), group_bits))
        # stated here, so that both readers of the counts share one exchange
        .filter(F.col("bucket_group").isNotNull())
    )
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("bucket_group").orderBy("bucket").rowsBetween(*earlier)
    across = Window.orderBy("bucket_group").rowsBetween(*earlier)
    counted = counts.withColumn("inside_before", _before(inside))
    # read off the same sorted groups, so both levels share one exchange
    group_rows = F.max(F.col("inside_before") + F.col("bucket_rows"))
    groups = (
        counted.groupBy("bucket_group")
        .agg(group_rows.alias("bucket_rows"))
        .select("bucket_group", _before(across).alias("group_before"))
    )
    return counted.join(groups, "bucket_group").select(
        "bucket",
        "bucket_rows",
        (F.col("inside_before") + F.col("group_before")).alias("rows_before"),
    )


def number_rows(
    rows: DataFrame,
    key: str = "id",
    name: str = "row_no",
    bits: int = BUCKET_BITS,
    repeats: str | None = None,
) -> DataFrame:
    """Adds a 1-based dense ``name`` in ``key`` order. Keys are unique; a null one raises an error.

    ``rows`` is evaluated twice, the first time for its keys only; put down rows that are
    costly to come by before numbering them. ``repeats`` names a column to tell rows whose key
    is that of the row before, which the order of the numbers shows at no further cost.
    """
    inside = Window.partitionBy("bucket").orderBy(key)
    numbered = rows.withColumn("bucket", bucket(_present(key), bits)).withColumn(
        "inside_no", F.row_number().over(inside)
    )
    if repeats:
        numbered = numbered.withColumn(repeats, F.col(key).eqNullSafe(F.lag(key).over(inside)))
    offsets = bucket_offsets(rows.select(key), key, bits).select("bucket", "rows_before")
    return (
        numbered.join(offsets, "bucket")
        .withColumn(name, F.col("rows_before") + F.col("inside_no"))
        .drop("bucket", "inside_no", "rows_before")
    )


def chunk_numbers(
    rows: DataFrame, size: int = CHUNK_SIZE, key: str = "id", bits: int = BUCKET_BITS
) -> DataFrame:
    """Adds ``row_no`` and the 1-based ``chunk_no`` of consecutive ``size``-row chunks."""
    row = F.col("row_no")
    return number_rows(rows, key, bits=bits).withColumn(
        "chunk_no", F.call_function("div", row - 1, F.lit(size)) + F.lit(1)
    )
