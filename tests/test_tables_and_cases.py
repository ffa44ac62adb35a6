"""Stored tables, the generator, the eight cases and JDBC settings."""

import json
import uuid
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyspark.__main__ import main
from tallyspark.operators.runlog import case_speedup, step_totals
from tallyspark.operators.scans import confirmed_scan
from tallyspark.operators.settle import settlement_projection, stamp, unsettled_orders
from tallyspark.plans.append import (
    append_new_settlements,
    appended_settlements,
    current_orders,
    settle_stream,
)
from tallyspark.plans.cases import CASES, reset_tables, run_case, seed_orders
from tallyspark.schema import CONFIRMED, ORDERS, SETTLED, SETTLEMENT_FACTS, STEP_EXECUTIONS
from tallyspark.session import cluster_settings, held, scratch_folder
from tallyspark.sources import jdbc, tables
from tallyspark.sources.fixtures import SETTLED_AT
from tallyspark.sources.generate import generate_orders, missing_orders, top_up_orders
from tallyspark.streaming.incremental import orders_stream


def test_versions(spark, make_orders, tmp_path):
    root = f"{tmp_path}/orders"
    assert tables.read_table(spark, root, ORDERS).count() == 0
    assert tables.write_version(make_orders((1, 1)), root) == 0
    current = tables.read_table(spark, root, ORDERS)
    assert tables.write_version(current.unionByName(make_orders((2, 2))), root) == 1
    assert tables.read_table(spark, root, ORDERS).count() == 2
    assert tables.truncate(spark, root, ORDERS) == 2
    empty = tables.read_table(spark, root, ORDERS)
    assert empty.count() == 0
    assert [f.name for f in empty.schema] == ORDERS.names


def test_unfinished_version_is_ignored_and_replaced(spark, make_orders, tmp_path):
    root = f"{tmp_path}/orders"
    tables.write_version(make_orders((1, 1)), root)
    make_orders((9, 9)).write.parquet(f"{root}/v=1")
    (tmp_path / "orders" / "v=1" / "_SUCCESS").unlink()
    assert tables.latest_version(spark, root) == 0
    assert tables.read_table(spark, root, ORDERS).first().id == 1
    assert tables.write_version(make_orders((2, 2)), root) == 1
    assert [r.id for r in tables.read_table(spark, root, ORDERS).collect()] == [2]


def test_appending_a_batch_again_replaces_it(spark, make_orders, tmp_path):
    folder = f"{tmp_path}/log"
    for batch, rows in ((0, [(1, 1)]), (1, [(2, 2), (3, 3)]), (1, [(2, 2)])):
        tables.append_batch(make_orders(*rows), folder, batch)
    assert sorted(r.id for r in tables.read_batches(spark, folder, ORDERS).collect()) == [1, 2]
    assert [r.id for r in tables.read_batches(spark, folder, ORDERS, before=1).collect()] == [1]
    tables.append_batch(make_orders((9, 9)), folder, 2)
    (Path(folder) / "batch_id=2" / "_SUCCESS").unlink()
    assert sorted(r.id for r in tables.read_batches(spark, folder, ORDERS).collect()) == [1, 2]


def test_clustered_files_hold_disjoint_id_ranges(spark, tmp_path):
    shuffled = generate_orders(spark, 20_000, SETTLED_AT).repartition(8)
    # AQE would merge this little data into one file
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_version(tables.cluster_by_id(shuffled), f"{tmp_path}/orders")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = tables.read_table(spark, f"{tmp_path}/orders", ORDERS).groupBy(F.input_file_name())
    found = files.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    spans = sorted((r.lo, r.hi) for r in found)
    assert len(spans) > 1
    assert all(before[1] < after[0] for before, after in zip(spans, spans[1:]))


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path}/bucketed'")
    orders = generate_orders(spark, 5_000, SETTLED_AT)
    facts = stamp(settlement_projection(orders.filter("id % 2 = 0")), SETTLED_AT)
    tables.save_bucketed(orders, "bucketed.orders", "id", 4)
    tables.save_bucketed(facts, "bucketed.settlements", "order_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = unsettled_orders(spark.table("bucketed.orders"), spark.table("bucketed.settlements"))
        assert left.count() == 2_500
        assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_generated_orders(spark):
    made = generate_orders(spark, 100_000, SETTLED_AT)
    assert made.schema.names == ORDERS.names
    assert [f.dataType for f in made.schema] == [f.dataType for f in ORDERS]
    stats = made.agg(
        F.countDistinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi"),
        F.countDistinct("seller_id").alias("sellers"), F.min("seller_id"), F.max("seller_id"),
        F.min("amount").alias("least"), F.max("amount").alias("most"),
        F.avg("amount").alias("mean"),
    ).first()
    assert tuple(stats)[:6] == (100_000, 1, 100_000, 500, 1, 500)
    assert 1_000 <= stats.least < 1_010 and 99_990 < stats.most <= 100_000
    assert stats["mean"] == pytest.approx(50_500, rel=0.01)


def test_generated_orders_do_not_depend_on_the_split(spark):
    made = generate_orders(spark, 1_000, SETTLED_AT)
    tail = generate_orders(spark, 400, SETTLED_AT, first_id=601)
    assert made.filter("id > 600").exceptAll(tail).count() == 0


@pytest.mark.parametrize(("target", "added"), [(0, 0), (2, 0), (3, 0), (10, 7)])
def test_top_up(make_orders, target, added):
    orders = make_orders((1, 1), (5, 1), (20, 1))
    assert missing_orders(orders, target, SETTLED_AT).count() == added
    ids = [r.id for r in top_up_orders(orders, target, SETTLED_AT).collect()]
    assert sorted(ids) == [1, 5, 20, *range(21, 21 + added)]


def test_top_up_of_nothing(spark):
    empty = spark.createDataFrame([], ORDERS)
    assert [r.id for r in top_up_orders(empty, 3, SETTLED_AT).orderBy("id").collect()] == [1, 2, 3]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("cases"))
    tables.write_version(generate_orders(spark, 120_000, SETTLED_AT), f"{folder}/orders")
    return folder


@pytest.mark.parametrize("name", CASES)
def test_case(spark, stored, name):
    log = {r.step_name: r for r in run_case(spark, name, stored, SETTLED_AT).collect()}
    total = log.pop("step", None) or log.pop("masterStep")
    inserted = 100_000 if name.startswith("insert") else 120_000
    assert (total.case_name, total.read_count, total.write_count) == (name, inserted, inserted)
    assert sum(r.read_count for r in log.values()) == (120_000 if name == "partitioning" else 0)
    orders = tables.read_table(spark, f"{stored}/orders", ORDERS)
    assert orders.count() == 120_000
    if CASES[name].inserts:
        settlements = tables.read_table(spark, f"{stored}/settlements", SETTLEMENT_FACTS)
        assert settlements.select("order_id").distinct().count() == inserted
        assert settlements.count() == inserted
        assert settlements.filter("fee + net_amount != amount").count() == 0
    if CASES[name].updates:
        assert _all_settled(spark, stored)


def _all_settled(spark, folder):
    orders = tables.read_table(spark, f"{folder}/orders", ORDERS)
    return orders.filter(F.col("status") != SETTLED).count() == 0


def test_unread_orders_keep_their_status(spark, make_orders, tmp_path):
    tables.write_version(make_orders((0, 1), (1, 1), (2, 1, SETTLED)), f"{tmp_path}/orders")
    log = run_case(spark, "writer-jpa", str(tmp_path), SETTLED_AT).first()
    assert log.read_count == 2
    orders = tables.read_table(spark, f"{tmp_path}/orders", ORDERS).collect()
    assert sorted((r.id, r.status) for r in orders) == [(0, CONFIRMED), (1, SETTLED), (2, SETTLED)]


def test_appending_new_settlements(spark, make_orders, tmp_path):
    def settled():
        rows = appended_settlements(spark, str(tmp_path)).collect()
        return sorted((r.id, r.order_id, r.fee) for r in rows)

    tables.write_version(make_orders((0, 100), (8, 100), (3, 200)), f"{tmp_path}/orders")
    assert append_new_settlements(spark, str(tmp_path), SETTLED_AT, bits=2) == 0
    assert settled() == [(1, 3, 6), (2, 8, 3)]
    assert append_new_settlements(spark, str(tmp_path), SETTLED_AT) == 1
    assert settled() == [(1, 3, 6), (2, 8, 3)]
    grown = make_orders((0, 100), (8, 100), (3, 200), (5, 300), (1, 400))
    tables.write_version(grown, f"{tmp_path}/orders")
    assert append_new_settlements(spark, str(tmp_path), SETTLED_AT) == 2
    assert settled() == [(1, 3, 6), (2, 8, 3), (3, 1, 12), (4, 5, 9)]
    open_orders = confirmed_scan(current_orders(spark, str(tmp_path)))
    assert [r.id for r in open_orders.collect()] == [0]


def test_a_reset_confirms_what_an_append_settled(spark, make_orders, tmp_path):
    folder = str(tmp_path)
    tables.write_version(make_orders((1, 100), (2, 200), (3, 300)), f"{folder}/orders")
    append_new_settlements(spark, folder, SETTLED_AT)
    assert confirmed_scan(current_orders(spark, folder)).count() == 0
    reset_tables(spark, folder)
    assert confirmed_scan(current_orders(spark, folder)).count() == 3
    run_case(spark, "insert-identity", folder, SETTLED_AT, insert_count=2)
    assert [r.id for r in confirmed_scan(current_orders(spark, folder)).collect()] == [3]
    append_new_settlements(spark, folder, SETTLED_AT)
    settled = appended_settlements(spark, folder).collect()
    assert sorted((r.id, r.order_id) for r in settled) == [(1, 1), (2, 2), (3, 3)]


def test_stream_and_appends_share_their_settlements(spark, make_orders, tmp_path):
    folder = str(tmp_path)

    def arrive(*rows):
        make_orders(*rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = orders_stream(spark, f"{folder}/in")
        settle_stream(stream, folder, f"{folder}/progress", SETTLED_AT).awaitTermination()

    def settled():
        rows = appended_settlements(spark, folder).collect()
        return sorted((r.id, r.order_id) for r in rows)

    every = make_orders((1, 100), (2, 200), (3, 300), (4, 400), (5, 500))
    tables.write_version(every.filter("id <= 3"), f"{folder}/orders")
    arrive((2, 200))
    append_new_settlements(spark, folder, SETTLED_AT)
    assert settled() == [(1, 2), (2, 1), (3, 3)]
    arrive((3, 300), (4, 400))
    tables.write_version(every, f"{folder}/orders")
    append_new_settlements(spark, folder, SETTLED_AT)
    assert settled() == [(1, 2), (2, 1), (3, 3), (4, 4), (5, 5)]
    assert confirmed_scan(current_orders(spark, folder)).count() == 0
    reset_tables(spark, folder)
    assert settled() == []


def test_rows_of_a_lost_append_are_not_seen(spark, make_orders, tmp_path):
    root = f"{tmp_path}/orders"
    tables.write_version(make_orders((1, 1)), root)
    tables.append_rows(make_orders((2, 2)), root)
    (tmp_path / "orders" / "v=0" / "batch_id=1" / "_SUCCESS").unlink()
    assert [r.id for r in tables.read_table(spark, root, ORDERS).collect()] == [1]
    failing = make_orders((3, 3)).withColumn("amount", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        tables.append_rows(failing, root)
    assert [r.id for r in tables.read_table(spark, root, ORDERS).collect()] == [1]
    assert tables.append_rows(make_orders((2, 2)), root) == 1
    assert sorted(r.id for r in tables.read_table(spark, root, ORDERS).collect()) == [1, 2]


def test_old_versions_are_dropped(spark, make_orders, tmp_path):
    root = f"{tmp_path}/orders"
    for n in range(4):
        tables.write_version(make_orders((n, n)), root)
    make_orders((9, 9)).write.parquet(f"{root}/v=4/batch_id=0")
    (tmp_path / "orders" / "v=4" / "batch_id=0" / "_SUCCESS").unlink()
    assert tables.drop_old_versions(spark, root, keep=2) == [1, 0]
    assert sorted(p.name for p in Path(root).iterdir()) == ["v=2", "v=3", "v=4"]
    assert tables.read_table(spark, root, ORDERS).first().id == 3
    with pytest.raises(ValueError):
        tables.drop_old_versions(spark, root, keep=0)


def test_held_rows_are_removed_after_use(spark, make_orders):
    with held(make_orders((1, 1)), "x") as rows:
        files = rows.inputFiles()
        assert rows.count() == 1 and files
    assert not any(Path(name.removeprefix("file://")).exists() for name in files)


def test_run_logs_feed_the_comparison(spark, make_orders, tmp_path):
    tables.write_version(make_orders((1, 100), (2, 200)), f"{tmp_path}/orders")
    for number, name in enumerate(CASES):
        log = run_case(spark, name, str(tmp_path), SETTLED_AT)
        tables.append_batch(log, f"{tmp_path}/steps", number)
    steps = tables.read_batches(spark, f"{tmp_path}/steps", STEP_EXECUTIONS)
    assert {r.total_read for r in step_totals(steps).collect()} >= {2}
    assert sorted(r.axis for r in case_speedup(steps).collect()) == [
        "insert", "parallel", "reader", "writer",
    ]


def test_range_workers_read_every_id(spark, make_orders, tmp_path):
    tables.write_version(make_orders((-5, 1), (0, 1, SETTLED), (3, 1)), f"{tmp_path}/orders")
    log = run_case(spark, "partitioning", str(tmp_path), SETTLED_AT)
    assert log.filter("step_name = 'masterStep'").first().read_count == 3
    assert _all_settled(spark, str(tmp_path))


def test_seeding_tops_the_stored_orders_up(spark, tmp_path):
    for target, rows in ((30, 30), (30, 30), (20, 30), (45, 45)):
        seed_orders(spark, str(tmp_path), target, SETTLED_AT)
        orders = tables.read_table(spark, f"{tmp_path}/orders", ORDERS)
        assert sorted(r.id for r in orders.collect()) == list(range(1, rows + 1))


def test_command_line(spark, tmp_path, capsys):
    main([str(tmp_path), "reader-zero-offset", "sequential", "--orders", "1500"])
    shown = capsys.readouterr().out
    assert shown.count("1,500") == 4
    steps = tables.read_batches(spark, f"{tmp_path}/steps", STEP_EXECUTIONS)
    assert sorted(r.case_name for r in steps.collect()) == ["reader-zero-offset", "sequential"]
    with pytest.raises(SystemExit):
        main([str(tmp_path), "no-such-case"])


def test_a_case_starts_from_a_reset(spark, make_orders, tmp_path):
    tables.write_version(make_orders((1, 1, SETTLED), (2, 1)), f"{tmp_path}/orders")
    run_case(spark, "sequential", str(tmp_path), SETTLED_AT)
    run_case(spark, "insert-identity", str(tmp_path), SETTLED_AT)
    orders = tables.read_table(spark, f"{tmp_path}/orders", ORDERS).collect()
    assert {r.status for r in orders} == {CONFIRMED}
    run_case(spark, "writer-jpa", str(tmp_path), SETTLED_AT)
    assert tables.read_table(spark, f"{tmp_path}/settlements", SETTLEMENT_FACTS).count() == 0


def test_jdbc_ranges_are_closed_and_cover_the_ids():
    assert jdbc.id_range_predicates(1, 10, 4) == [
        "id >= 1 AND id <= 3", "id >= 4 AND id <= 6",
        "id >= 7 AND id <= 9", "id >= 10 AND id <= 10",
    ]
    assert jdbc.id_range_predicates(1, 5, 4)[-1] == "id >= 5 AND id <= 5"
    assert jdbc.id_range_predicates(5, 4, 4) == []


def test_jdbc_settings():
    assert jdbc.read_settings() == {"fetchsize": "1000", "preferTimestampNTZ": "true"}
    assert jdbc.write_settings() == {"batchsize": "1000", "numPartitions": "10"}


def test_jdbc_rows_are_sorted_within_a_connection(spark):
    shuffled = spark.range(500).repartition(4, F.xxhash64("id"))
    ordered = jdbc.statement_order(shuffled, "id").withColumn("part", F.spark_partition_id())
    parts = {}
    for row in ordered.collect():
        parts.setdefault(row.part, []).append(row.id)
    assert sum(map(len, parts.values())) == 500
    assert all(ids == sorted(ids) for ids in parts.values())


def test_status_updates_go_out_in_ordered_batches(spark, tmp_path):
    folder = str(tmp_path)

    class Connection:
        """Writes what a database would be sent to a file per connection."""

        def __init__(self):
            self.log = open(f"{folder}/{uuid.uuid4().hex}", "w")

        def cursor(self):
            return self

        def executemany(self, statement, rows):
            self.log.write(json.dumps([statement, rows]) + "\n")

        def commit(self):
            self.log.flush()

        def close(self):
            self.log.close()

    keys = spark.range(1, 2_501).withColumnRenamed("id", "order_id").repartition(7)
    jdbc.update_status(keys, Connection, connections=3, batch=400, placeholder="%s")
    logs = [[json.loads(line) for line in path.open()] for path in tmp_path.iterdir()]
    assert len(logs) == 3
    updated = []
    for log in logs:
        assert all(s == "UPDATE orders SET status = %s WHERE id = %s" for s, _ in log)
        assert all(len(rows) == 400 for _, rows in log[:-1])
        ids = [i for _, rows in log for status, i in rows if status == SETTLED]
        assert ids == sorted(ids)
        updated += ids
    assert sorted(updated) == list(range(1, 2_501))


def test_bounds_are_left_to_the_database():
    assert jdbc.confirmed_bounds_query() == (
        "(SELECT MIN(id) AS min_id, MAX(id) AS max_id FROM orders"
        " WHERE status = 'CONFIRMED') bounds"
    )


@pytest.mark.parametrize("name", CASES)
def test_case_without_orders(spark, tmp_path, name):
    log = run_case(spark, name, str(tmp_path), SETTLED_AT)
    assert log.agg(F.sum("read_count")).first()[0] == 0


def test_scratch_folder_is_under_the_shared_one(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    folder = scratch_folder(spark, "x")
    assert folder != scratch_folder(spark, "x")
    assert root is None or folder.startswith(root)


def test_a_cluster_must_name_its_shared_folder():
    no_setting = SimpleNamespace(get=lambda key, default: default)
    context = SimpleNamespace(master="yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(SimpleNamespace(conf=no_setting, sparkContext=context), "x")


def test_shuffle_partitions_grow_with_the_data():
    key = "spark.sql.shuffle.partitions"
    assert cluster_settings(10**9)[key] == "200"
    assert int(cluster_settings(20 * 10**12)[key]) == 149_012
