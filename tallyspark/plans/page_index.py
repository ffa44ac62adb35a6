"""Offset pages through an index that is stored beside a version of a table.

The index is a cumulative histogram of ids: for each bucket of 2**bits ids that holds rows, the
span of ids and the numbers of rows before and up to it. It is sorted by these numbers, so the
lookup of an offset is a pair of range conditions that Parquet statistics answer, and a page
costs the same few row groups wherever it lies. Rows are counted once, when the index is
built, and not for every page.

An index belongs to one version and one condition, as versions never change but for batches
appended to them. ``refresh`` counts only batches that came since; if their ids lie above all
counted ones, which generated and arriving orders do, their buckets go on where the others
end. Otherwise the index is built anew. Readers see the old index until the new one is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.ids import bucket_end, bucket_start
from tallyspark.operators.numbering import bucket_offsets
from tallyspark.operators.pages import PAGE_BITS
from tallyspark.schema import CHUNK_SIZE, CONFIRMED, ORDERS
from tallyspark.sources.tables import (
    append_rows,
    current_folder,
    finished_batches,
    read_batches,
    read_table,
    write_version,
)

#: A span of ids, the rows in it, and those before and up to its end. Rows without ``first_id``
#: close what one refresh has counted: up to which batch, and its highest id.
INDEX = T.StructType(
    [
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("rows_before", T.LongType()),
        T.StructField("rows_upto", T.LongType()),
        T.StructField("covers", T.IntegerType()),
    ]
)

#: Small row groups, so that a lookup in an index of many millions of buckets reads few of them.
ROW_GROUP_BYTES = 1 << 20


def confirmed() -> Column:
    return F.col("status") == CONFIRMED


def index_root(folder: str, name: str) -> str:
    return f"{folder}/offsets-{name}"


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("rows_before").sortWithinPartitions("rows_before")


def _counted(ids: DataFrame, since: int, above: int | None, covers: int, bits: int) -> DataFrame:
    """Index rows of ids that lie above ``above`` and have ``since`` rows before them."""
    held = bucket_offsets(ids, bits=bits)
    low, high = bucket_start(F.col("bucket"), bits), bucket_end(F.col("bucket"), bits)
    if above is not None:
        # a bucket that was begun before goes on behind the ids counted then
        low = F.greatest(low, F.lit(above + 1))
    highest = ids.agg(F.max("id")).scalar()
    before = F.col("rows_before") + since
    return held.select(
        low.alias("first_id"),
        F.least(high, highest).alias("last_id"),
        before.alias("rows_before"),
        (before + F.col("bucket_rows")).alias("rows_upto"),
        F.lit(covers).alias("covers"),
    )


def _closing(spark: SparkSession, rows: int, highest: int | None, covers: int) -> DataFrame:
    return spark.createDataFrame([(None, highest, rows, rows, covers)], INDEX)


def _state(index: DataFrame) -> tuple[int, int, int | None] | None:
    """The last batch counted, all rows and the highest id up to it; None without an index."""
    last = F.max(F.struct("covers", F.col("rows_upto").alias("rows"), F.col("last_id").alias("high")))
    found = index.filter(F.col("first_id").isNull()).agg(last.alias("last")).first()["last"]
    return tuple(found) if found else None


def refresh(
    spark: SparkSession,
    root: str,
    name: str,
    where: Column,
    schema: T.StructType = ORDERS,
    bits: int = PAGE_BITS,
) -> str:
    """Brings the index of the current version up to date and returns its root."""
    folder = current_folder(spark, root)
    if folder is None:
        raise ValueError(f"{root} has no version to index")
    place = index_root(folder, name)
    newest = finished_batches(spark, folder)[0]
    state = _state(read_table(spark, place, INDEX))
    if state and state[0] >= newest:
        return place
    covered, since, above = state or (-1, 0, None)
    ids = read_batches(spark, folder, schema, since=covered + 1).filter(where).select("id")
    low, high, count = ids.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    extends = state and (low is None or above is None or low > above)
    if state and not extends:
        covered, since, above = -1, 0, None
        ids = read_batches(spark, folder, schema).filter(where).select("id")
        high, count = ids.agg(F.max("id"), F.count(F.lit(1))).first()
    rows = _sorted(_counted(ids, since, above, newest, bits))
    closing = _closing(spark, since + count, above if high is None else high, newest)
    rows = rows.unionByName(closing)
    if extends:
        append_rows(rows, place, {"parquet.block.size": str(ROW_GROUP_BYTES)})
    else:
        write_version(rows, place, {"parquet.block.size": str(ROW_GROUP_BYTES)})
    return place


def indexed_page(
    spark: SparkSession,
    root: str,
    name: str,
    where: Column,
    page: int,
    size: int = CHUNK_SIZE,
    schema: T.StructType = ORDERS,
) -> DataFrame:
    """Page ``page`` (from 0) of ``size`` rows that meet ``where``; empty past the end.

    The index must be up to date; a version without it raises an error.
    """
    folder = current_folder(spark, root)
    index = read_table(spark, index_root(folder, name), INDEX) if folder else None
    rows = read_table(spark, root, schema).filter(where)
    state = _state(index) if index is not None else None
    if not state or state[0] < finished_batches(spark, folder)[0]:
        raise ValueError(f"the index {name} of {root} is not up to date")
    low, high = page * size, page * size + size
    hit = (F.col("rows_upto") > low) & (F.col("rows_before") < high) & F.col("first_id").isNotNull()
    first, last, before = (
        index.filter(hit).agg(F.min("first_id"), F.max("last_id"), F.min("rows_before")).first()
    )
    if first is None:
        return rows.filter(F.lit(False))
    near = rows.filter(F.col("id").between(first, last))
    return near.orderBy("id").offset(low - before).limit(size)
