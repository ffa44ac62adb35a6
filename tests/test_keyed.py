"""Incremental settlement with settled ids in streaming state."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallyspark import queries
from tallyspark.operators.runlog import chunk_first_latest
from tallyspark.sources import tables
from tallyspark.sources.fixtures import SETTLED_AT
from tallyspark.sources.generate import generate_orders
from tallyspark.streaming import keyed, runlog
from tallyspark.streaming.incremental import orders_stream


@pytest.fixture
def arrive(make_orders, tmp_path):
    def add(*rows):
        make_orders(*rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    return add


@pytest.fixture
def run(spark, tmp_path):
    def settle(bits=3):
        stream = orders_stream(spark, f"{tmp_path}/in", files_per_trigger=1)
        query = keyed.start_keyed(stream, f"{tmp_path}/out", f"{tmp_path}/progress", SETTLED_AT, bits)
        query.awaitTermination()
        return query

    return settle


@pytest.fixture
def settled(spark, tmp_path):
    def rows():
        found = keyed.keyed_settlements(spark, f"{tmp_path}/out").collect()
        return sorted((r["id"], r["order_id"], r["amount"]) for r in found)

    return rows


def test_late_repeats_over_restarts(arrive, run, settled):
    arrive((1, 10), (40, 40), (8, 80))
    run()
    assert settled() == [(1, 1, 10), (2, 8, 80), (3, 40, 40)]
    arrive((8, 99), (2, 20), (0, 5), (-3, 5))
    arrive((1, 11), (40, 1), (3, 30))
    run()
    assert settled()[3:] == [(4, 2, 20), (5, 3, 30)]
    run()
    assert len(settled()) == 5


def test_the_smallest_of_copies_that_arrive_together(arrive, run, settled):
    arrive((5, 300), (5, 100), (5, 200), *[(6, n) for n in range(50, 90)])
    run()
    assert settled() == [(1, 5, 100), (2, 6, 50)]


def test_a_batch_without_anything_new_is_recorded(spark, arrive, run, settled, tmp_path):
    arrive((1, 10))
    run()
    arrive((1, 10))
    run()
    arrive((2, 20))
    run()
    assert settled() == [(1, 1, 10), (2, 2, 20)]
    records = keyed.batch_records(spark, f"{tmp_path}/out").orderBy("batch").collect()
    assert [tuple(r)[:3] for r in records] == [(0, 1, 1), (1, 0, 1), (2, 1, 2)]
    assert all(r["elapsed_ms"] > 0 for r in records)


@pytest.mark.parametrize("step", ["append_batch", "audited_append"])
def test_a_batch_lost_half_way_is_repeated(spark, arrive, run, settled, monkeypatch, step):
    arrive((1, 10), (2, 20))
    run()
    arrive((2, 21), (3, 30), (9, 90))

    def lost(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(keyed, step, lost)
        with pytest.raises(StreamingQueryException):
            run()
    run()
    assert settled() == [(1, 1, 10), (2, 2, 20), (3, 3, 30), (4, 9, 90)]


def test_no_micro_batch_reads_earlier_ones(arrive, run, settled, monkeypatch, tmp_path):
    """Neither listed nor read: what was settled may even be moved away meanwhile."""
    arrive((1, 10), (2, 20))
    run()
    (tmp_path / "out" / "batch_id=0").rename(tmp_path / "aside")
    arrive((1, 10), (3, 30))
    for name in ("finished_batches", "highest_id", "next_batch"):
        monkeypatch.setattr(tables, name, lambda *a, **k: pytest.fail("looked for batches"))
    run()
    monkeypatch.undo()
    (tmp_path / "aside").rename(tmp_path / "out" / "batch_id=0")
    assert settled() == [(1, 1, 10), (2, 2, 20), (3, 3, 30)]


def test_the_state_is_small(spark, run, tmp_path):
    generate_orders(spark, 100_000, SETTLED_AT).write.parquet(f"{tmp_path}/in")
    query = run(bits=keyed.STATE_BITS)
    entries, size = keyed.state_size(query)
    assert entries == 100_000 // 4096 + 1
    assert size < 60_000  # plain ids alone would take 800,000


def test_another_checkpoint_is_refused(spark, arrive, run, tmp_path):
    arrive((1, 10))
    run()
    stream = orders_stream(spark, f"{tmp_path}/in")
    with pytest.raises(ValueError, match="another checkpoint"):
        keyed.start_keyed(stream, f"{tmp_path}/out", f"{tmp_path}/other", SETTLED_AT)


def test_the_log_of_a_stream(spark, arrive, run):
    for rows in ([(1, 10), (2, 20), (2, 30)], [(2, 20), (3, 30)], [(3, 1)]):
        arrive(*rows)
    log = runlog.StreamLog()
    spark.streams.addListener(log)
    try:
        query = run()
        assert {b: counts[:2] for b, counts in log.batches(query).items()} == {0: (3, 2), 1: (2, 1), 2: (1, 0)}
        step = runlog.step_executions(spark, log, query, "incremental").first()
        assert tuple(step)[:5] == ("incremental", "settle", 6, 3, 3) and step["duration_ms"] > 0
        timing = chunk_first_latest(runlog.chunk_timings(spark, log, query)).first()
        assert timing["chunk_count"] == 3 and timing["first_ms"] > 0
        again = run()
        assert log.batches(again) == {}
    finally:
        spark.streams.removeListener(log)


@pytest.fixture
def feed(spark, tmp_path, monkeypatch):
    """Tables of 400 orders, ids 1 to 400, with three lines each, and the folder of the run."""
    keys = spark.range(400).withColumnRenamed("id", "o_orderkey")
    keys.selectExpr(
        "o_orderkey", "o_orderkey % 7 AS o_custkey", "'O' AS o_orderstatus", "o_orderkey + 0.5D AS o_totalprice",
        "TIMESTAMP_NTZ '2026-03-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    lines = keys.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), F.lit(3))))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(queries, "scratch_folder", lambda *_: f"{tmp_path}/run")
    monkeypatch.setattr(queries, "FEED_ROWS", 100, raising=False)
    return tmp_path


def _rows_of_files(spark, folder):
    files = spark.read.parquet(folder).groupBy(F.input_file_name()).count()
    return [r["count"] for r in files.collect()]


def test_no_task_makes_a_part_of_the_feed_by_itself(spark, feed):
    found = queries.keyed_settle(spark, str(feed)).collect()
    assert sorted((r["order_id"], r["amount"]) for r in found) == [(n, n * 100 - 50) for n in range(1, 401)]
    # 3 lines of 400 orders: a quarter of them in the first part, all of them in the last
    files = _rows_of_files(spark, f"{feed}/run/in")
    assert sum(files) == 1_200 * (1 + 2 + 3 + 4) // 4
    assert len(files) > 4 and max(files) < 300
    records = keyed.batch_records(spark, f"{feed}/run/out").orderBy("batch").collect()
    assert [tuple(r)[:3] for r in records] == [(n, 100, 100 * n + 100) for n in range(4)]


def test_the_report_covers_the_runs_of_all_parts(spark, feed):
    report = queries.stream_run_report(spark, str(feed)).collect()
    assert [tuple(r) for r in report] == [("incremental", 3_000, 400, 2_600, 4)]
    assert max(_rows_of_files(spark, f"{feed}/run/in")) < 300


def test_the_state_is_dealt_to_more_tasks_the_more_rows_there_are(spark, feed, monkeypatch):
    """400 orders and 1,200 lines, whatever few tasks the session shuffles to."""
    monkeypatch.setattr(queries, "STATE_ROWS", 100, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert int(before) < 16
    _, runs = queries._settled_feed(spark, str(feed))
    states = [query.lastProgress["stateOperators"][0] for query in runs]
    assert [state["numShufflePartitions"] for state in states] == [16] * 4
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    settled = keyed.keyed_settlements(spark, f"{feed}/run/out").collect()
    assert sorted((r["id"], r["order_id"] % 4) for r in settled) == [(n, (n - 1) // 100) for n in range(1, 401)]
    assert sorted(r["order_id"] for r in settled) == list(range(1, 401))


def test_a_stream_keeps_the_partitions_of_its_state(spark, arrive, settled, tmp_path):
    def run(partitions):
        stream = orders_stream(spark, f"{tmp_path}/in")
        query = keyed.start_keyed(stream, f"{tmp_path}/out", f"{tmp_path}/progress", SETTLED_AT, 3, partitions)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numShufflePartitions"]

    arrive((1, 10), (40, 40))
    assert run(11) == 11
    arrive((40, 1), (3, 30))
    assert run(20) == 11
    assert settled() == [(1, 1, 10), (2, 40, 40), (3, 3, 30)]
