"""Incremental settlement: each trigger settles the order files that arrived since.

The checkpoint remembers which files are done, so a stopped run goes on where it was. A
micro-batch goes to its own ``batch_id`` folder; one that is replayed after a failure
overwrites that folder and looks only at earlier ones, hence adds nothing twice.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tallyspark.operators.scans import full_read
from tallyspark.operators.settle import newly_arrived, numbered_settlements, to_settle
from tallyspark.schema import CHUNK_TIMINGS, ORDERS, SETTLEMENT_FACTS
from tallyspark.session import held
from tallyspark.sources.tables import append_batch, exists, highest_id, read_batches

#: Files per trigger of a stream that takes all that has arrived as one micro-batch.
ALL_FILES = 2**31 - 1


def orders_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType = ORDERS,
    files: str = "*.parquet",
    files_per_trigger: int = 1_000,
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def table_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1_000
) -> DataFrame:
    """A stored table as a stream, be it one file or a folder of part files."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(location).isDirectory():
        return orders_stream(spark, path, schema, files_per_trigger=files_per_trigger)
    folder, file = path.rsplit("/", 1)
    return orders_stream(spark, folder, schema, file, files_per_trigger)


def settle_batch(
    out: str, settled_at: dt.datetime, step: str = "settle", beside: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Writer of one micro-batch: orders not settled by an earlier one, nor in the batches of
    the folder ``beside``. Ids go on from the highest of both.

    The batch is read once and put down. Earlier settlements are read only within its id
    range. Ids grow with time, so that touches the row groups of late arrivals rather than
    the whole table. Of several copies of an order in one batch the smallest (seller, amount)
    is settled, the same one in a replay. The batch's time is appended to ``out``_timings.
    """

    def settled_between(spark: SparkSession, batch_id: int, low: int, high: int) -> DataFrame:
        earlier = read_batches(spark, out, SETTLEMENT_FACTS, before=batch_id)
        if beside:
            earlier = earlier.unionByName(read_batches(spark, beside, SETTLEMENT_FACTS))
        return earlier.filter(F.col("order_id").between(low, high))

    def write(batch: DataFrame, batch_id: int) -> None:
        started = time.monotonic()
        spark = batch.sparkSession
        one = F.min(F.struct("seller_id", "amount")).alias("one")
        with held(batch.groupBy("id").agg(one).select("id", "one.*"), "arrived") as arrived:
            low, high = arrived.agg(F.min("id"), F.max("id")).first()
            if low is None:
                return
            earlier = settled_between(spark, batch_id, low, high)
            highest = highest_id(spark, out, before=batch_id)
            if beside:
                highest = max(highest, highest_id(spark, beside))
            # before the first batch nothing is settled: no join, and nothing more to put down
            joined = nullcontext(arrived)
            if batch_id > 0 or beside:
                joined = held(newly_arrived(arrived, earlier), "unsettled")
            with joined as unsettled:
                rows = numbered_settlements(unsettled, settled_at, F.lit(highest))
                append_batch(rows, out, batch_id)
        elapsed = (time.monotonic() - started) * 1000
        timing = [(step, batch_id + 1, elapsed)]
        append_batch(spark.createDataFrame(timing, CHUNK_TIMINGS), f"{out}_timings", batch_id)

    return write


def start_settling(
    orders: DataFrame,
    out: str,
    checkpoint: str,
    settled_at: dt.datetime,
    beside: str | None = None,
) -> StreamingQuery:
    """Settles all that has arrived and then stops; start again to go on.

    The stream itself carries only what a settlement needs: a micro-batch is handed over
    complete and nothing is pruned behind that point.

    ``out`` and ``checkpoint`` belong together: a new checkpoint would number its batches
    from 0 again and overwrite settlements, so it is refused.
    """
    spark = orders.sparkSession
    if exists(spark, out) and not exists(spark, checkpoint):
        raise ValueError(f"{out} holds settlements of a run with another checkpoint")
    return (
        to_settle(full_read(orders))
        .writeStream.foreachBatch(settle_batch(out, settled_at, beside=beside))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def chunk_timings(spark: SparkSession, out: str) -> DataFrame:
    """(step, chunk_no, elapsed_ms) of every micro-batch that was settled into ``out``."""
    return read_batches(spark, f"{out}_timings", CHUNK_TIMINGS)


def settle_arrived(
    orders: DataFrame, out: str, checkpoint: str, settled_at: dt.datetime
) -> DataFrame:
    """Runs one round and returns all settlements so far."""
    start_settling(orders, out, checkpoint, settled_at).awaitTermination()
    return read_batches(orders.sparkSession, out, SETTLEMENT_FACTS)
