"""Incremental settlement: chunks of files, restarts, replays and late copies."""

import pytest
from pyspark.errors import StreamingQueryException

from tallyspark.operators.mutations import reset_orders
from tallyspark.operators.runlog import chunk_first_latest
from tallyspark.operators.scans import full_read
from tallyspark.operators.settle import to_settle
from tallyspark.schema import ORDERS, SETTLEMENT_FACTS
from tallyspark.sources import fixtures
from tallyspark.sources.fixtures import SETTLED_AT
from tallyspark.sources.generate import generate_orders
from tallyspark.sources.tables import read_batches
from tallyspark.streaming.incremental import (
    chunk_timings,
    orders_stream,
    settle_arrived,
    settle_batch,
    start_settling,
    table_stream,
)


@pytest.fixture
def run(spark, tmp_path):
    def settle(files_per_trigger=1):
        stream = orders_stream(spark, f"{tmp_path}/in", files_per_trigger=files_per_trigger)
        return settle_arrived(stream, f"{tmp_path}/out", f"{tmp_path}/progress", SETTLED_AT)

    return settle


@pytest.fixture
def arrive(spark, tmp_path):
    def add(first_id, count):
        made = generate_orders(spark, count, SETTLED_AT, first_id)
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    return add


def order_ids(rows):
    return sorted(r.order_id for r in rows.collect())


def test_one_batch_per_trigger_and_nothing_twice(spark, run, arrive, tmp_path):
    for first in (1, 101, 201, 301):
        arrive(first, 100)
    assert order_ids(run()) == list(range(1, 401))
    batches = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert batches == [f"batch_id={n}" for n in range(4)]
    assert order_ids(run()) == list(range(1, 401))


def test_chunk_timings_of_a_run(spark, arrive, tmp_path):
    for first in (1, 11, 21):
        arrive(first, 10)
    stream = orders_stream(spark, f"{tmp_path}/in", files_per_trigger=1)
    query = start_settling(stream, f"{tmp_path}/out", f"{tmp_path}/progress", SETTLED_AT)
    query.awaitTermination()
    timings = chunk_timings(spark, f"{tmp_path}/out")
    assert {1, 2, 3} <= {r.chunk_no for r in timings.collect()}
    assert chunk_first_latest(timings).first().first_ms > 0


def test_restart_goes_on_with_new_files(run, arrive):
    arrive(1, 50)
    assert len(order_ids(run())) == 50
    arrive(51, 30)
    assert order_ids(run()) == list(range(1, 81))


def test_another_checkpoint_is_refused(spark, run, arrive, tmp_path):
    arrive(1, 10)
    run()
    stream = orders_stream(spark, f"{tmp_path}/in")
    with pytest.raises(ValueError, match="another checkpoint"):
        start_settling(stream, f"{tmp_path}/out", f"{tmp_path}/elsewhere", SETTLED_AT)


def test_orders_sent_again_are_not_settled_again(run, arrive):
    arrive(1, 50)
    run()
    arrive(40, 30)
    assert order_ids(run()) == list(range(1, 70))


def test_replayed_batch_rewrites_the_same_rows(spark, make_orders, tmp_path):
    out = f"{tmp_path}/out"
    write = settle_batch(out, SETTLED_AT)
    first = make_orders((0, 5), (1, 100), (2, 200), (2, 200))
    second = make_orders((2, 200), (3, 300))
    for batch_id, batch in ((0, first), (1, second), (1, second), (0, first)):
        write(to_settle(full_read(batch)), batch_id)
    settled = read_batches(spark, out, SETTLEMENT_FACTS)
    assert sorted((r.order_id, r.fee) for r in settled.collect()) == [(1, 3), (2, 6), (3, 9)]


@pytest.mark.parametrize("after_writing", [False, True])
def test_run_lost_in_the_middle_of_a_batch(spark, run, arrive, tmp_path, after_writing):
    for first in (1, 101, 201):
        arrive(first, 100)
    write = settle_batch(f"{tmp_path}/out", SETTLED_AT)

    def write_and_fail(batch, batch_id):
        if batch_id != 1 or after_writing:
            write(batch, batch_id)
        if batch_id == 1:
            raise RuntimeError("lost")

    stream = orders_stream(spark, f"{tmp_path}/in", files_per_trigger=1)
    lost = (
        to_settle(full_read(stream))
        .writeStream.foreachBatch(write_and_fail)
        .option("checkpointLocation", f"{tmp_path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    with pytest.raises(StreamingQueryException):
        lost.awaitTermination()
    assert order_ids(run()) == list(range(1, 301))


def test_batch_without_readable_orders(spark, make_orders, tmp_path):
    out = f"{tmp_path}/out"
    write = settle_batch(out, SETTLED_AT)
    write(to_settle(make_orders((1, 100))), 0)
    write(to_settle(spark.createDataFrame([], ORDERS)), 1)
    assert order_ids(read_batches(spark, out, SETTLEMENT_FACTS)) == [1]


def test_timings_outlast_the_progress_that_spark_remembers(spark, arrive, tmp_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        for first in range(1, 60, 10):
            arrive(first, 10)
        stream = orders_stream(spark, f"{tmp_path}/in", files_per_trigger=1)
        start_settling(stream, f"{tmp_path}/out", f"{tmp_path}/progress", SETTLED_AT).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    chunks = {r.chunk_no for r in chunk_timings(spark, f"{tmp_path}/out").collect()}
    assert {1, 2, 3, 4, 5, 6} <= chunks


def test_a_folder_and_a_file_of_orders_settle_alike(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{source}/orders.parquet")
    raw.repartition(7).write.parquet(f"{tmp_path}/given/orders.parquet")
    settled = []
    for name, folder in (("file", source), ("folder", f"{tmp_path}/given")):
        stream = table_stream(spark, f"{folder}/orders.parquet", fixtures.RAW_ORDERS, files_per_trigger=2)
        orders = reset_orders(fixtures.orders_from_raw(stream))
        out = settle_arrived(orders, f"{tmp_path}/{name}", f"{tmp_path}/{name}_progress", SETTLED_AT)
        settled.append(sorted(tuple(r) for r in out.select(SETTLEMENT_FACTS.names).collect()))
    assert settled[0] == settled[1] and len(settled[0]) == 1_500
