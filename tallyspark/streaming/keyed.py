"""Incremental settlement that remembers settled ids itself, in keyed streaming state.

Which orders are settled is kept in the state store of the stream (RocksDB: on the executors'
disks, with changes in the checkpoint folder), one entry for 2**STATE_BITS neighbouring ids: a
bitmap, compressed, of some bytes for few ids and at most half a kilobyte. A micro-batch
thus reads its own arrivals and the entries of their ids, and neither reads nor lists what
earlier ones have written: settlement ids go on from the record that the batch before it has
left, the one file of the past that is opened.

All rows of one id meet in one group, chunk by chunk, and only the smallest (seller, amount) of
each id is held, so a hot id costs time and no memory. A replayed batch starts from the same
state, yields the same rows with the same ids and replaces what it had written.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tallyspark.functions.ids import bucket
from tallyspark.operators.scans import full_read
from tallyspark.operators.settle import numbered_settlements, to_settle
from tallyspark.plans.audited import audited_append
from tallyspark.schema import SETTLEMENTS
from tallyspark.session import held
from tallyspark.sources.tables import append_batch, batch_folder, exists, read_batches
from tallyspark.streaming.runlog import SETTLED, watched

#: Ids of one entry of the state.
STATE_BITS = 12
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHUFFLED_TO = "spark.sql.shuffle.partitions"

#: What a micro-batch leaves for the next one and for the run log.
RECORDS = T.StructType(
    [
        T.StructField("batch", T.LongType()),
        T.StructField("settled", T.LongType()),
        T.StructField("highest_id", T.LongType()),
        T.StructField("elapsed_ms", T.DoubleType()),
    ]
)

NEW_ORDERS = "id long, seller_id long, amount long"


def _first_arrivals(bits: int) -> Callable:
    """The state function: of one entry's arrivals those not settled before."""

    def settle(key: tuple, frames: Iterator, state) -> Iterator:
        import zlib

        import numpy as np
        import pandas as pd

        width = 1 << bits
        best = None
        for frame in frames:
            both = frame[["id", "seller_id", "amount"]] if best is None else pd.concat([best, frame[best.columns]])
            best = both.sort_values(["id", "seller_id", "amount"]).drop_duplicates("id")
        settled = np.zeros(width, bool)
        if state.exists:
            packed = np.frombuffer(zlib.decompress(state.get[0]), np.uint8)
            settled = np.unpackbits(packed).astype(bool)
        at = best["id"].to_numpy(np.int64) & (width - 1)
        new = best[~settled[at]]
        settled[at] = True
        state.update((zlib.compress(np.packbits(settled).tobytes()),))
        yield new

    return settle


def first_arrivals(orders: DataFrame, bits: int = STATE_BITS) -> DataFrame:
    """(id, seller_id, amount) of each order of a stream when it arrives first. Of copies that
    arrive together it is the one with the smallest seller and amount."""
    narrow = watched(to_settle(full_read(orders))).withColumn("span", bucket(F.col("id"), bits))
    new = narrow.groupBy("span").applyInPandasWithState(
        _first_arrivals(bits), NEW_ORDERS, "settled binary", "append", "NoTimeout"
    )
    return watched(new, SETTLED)


def _records(out: str) -> str:
    return f"{out}_records"


def _highest_before(spark: SparkSession, out: str, batch: int) -> int:
    """The highest settlement id that the batch before has left."""
    if batch == 0:
        return 0
    record = spark.read.schema(RECORDS).parquet(batch_folder(_records(out), batch - 1))
    return record.first()["highest_id"]


def settle_new(out: str, settled_at: dt.datetime) -> Callable[[DataFrame, int], None]:
    """Writer of one micro-batch of first arrivals, audited before it is visible."""

    def write(batch: DataFrame, batch_id: int) -> None:
        started = time.monotonic()
        spark = batch.sparkSession
        highest = _highest_before(spark, out, batch_id)
        seen = Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("rows"))
        with held(counted, "arrived") as arrived:
            count = seen.get["rows"]
            if count:
                rows = numbered_settlements(arrived, settled_at, F.lit(highest), repeats="repeated")
                audited_append(rows, out, batch_id, repeats="repeated")
        elapsed = (time.monotonic() - started) * 1000
        record = spark.createDataFrame([(batch_id, count, highest + count, elapsed)], RECORDS)
        append_batch(record.coalesce(1), _records(out), batch_id)

    return write


def start_keyed(
    orders: DataFrame,
    out: str,
    checkpoint: str,
    settled_at: dt.datetime,
    bits: int = STATE_BITS,
    partitions: int = 1,
) -> StreamingQuery:
    """Settles all that has arrived and then stops; start again to go on.

    The state lives in the checkpoint, so ``out`` is refused with another one. The width of an
    entry belongs to it, too: do not change ``bits`` of a stream that has run.

    The state is dealt to ``partitions`` tasks, or to as many as the session shuffles to if
    those are more. A stream keeps the number that it started with.
    """
    spark = orders.sparkSession
    if exists(spark, _records(out)) and not exists(spark, checkpoint):
        raise ValueError(f"{out} holds settlements of a run with another checkpoint")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    shuffled_to = spark.conf.get(SHUFFLED_TO)
    spark.conf.set(SHUFFLED_TO, str(max(partitions, int(shuffled_to))))
    try:
        return (
            first_arrivals(orders, bits)
            .writeStream.foreachBatch(settle_new(out, settled_at))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        # the stream has taken the settings over; the session's other jobs keep theirs
        spark.conf.set(SHUFFLED_TO, shuffled_to)


def batch_records(spark: SparkSession, out: str) -> DataFrame:
    """What each micro-batch has settled, and in what time."""
    return read_batches(spark, _records(out), RECORDS)


def keyed_settlements(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, out, SETTLEMENTS)


def state_size(query: StreamingQuery) -> tuple[int, int]:
    """Entries of the state and the bytes they take on disk, by the last progress report."""
    (state,) = query.lastProgress["stateOperators"]
    return state["numRowsTotal"], state["customMetrics"]["rocksdbSstFileSize"]
