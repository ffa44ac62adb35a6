"""The physical plans: what is pushed down, what shuffles and what never appears."""

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from tallyspark.operators import mutations, pages, scans, settle
from tallyspark.operators.numbering import number_rows
from tallyspark.operators.ranges import partition_stats
from tallyspark.queries import QUERIES
from tallyspark.schema import ORDERS
from tallyspark.sources import fixtures
from tallyspark.sources.fixtures import SETTLED_AT
from tallyspark.sources.generate import generate_orders
from tallyspark.sources.tables import read_table, write_version

FOLDER = f"{TESTDATA}/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    write_version(generate_orders(spark, 50_000, SETTLED_AT), root)
    return read_table(spark, root, ORDERS)


# a stream runs its own jobs; its result is a plain scan
STREAMS = {"incremental_settle", "keyed_settle", "stream_run_report"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert unwanted not in text


@pytest.mark.parametrize(
    "name",
    "settle_full settle_bounded settle_status settlement_projection confirmed_scan full_read"
    " id_range_scan orders_scan reset_orders status_length_violations".split(),
)
def test_settling_is_one_stage(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, FOLDER))


def test_ranged_settlement_shuffles_nothing_and_skips_outside_the_bounds(orders):
    status = F.when(F.col("id") > 900, "CONFIRMED").otherwise("SETTLED")
    recent = orders.withColumn("status", status)
    text = plan(settle.settle_ranged(recent, SETTLED_AT))
    assert "Exchange" not in text
    assert "GreaterThanOrEqual(id,901), LessThanOrEqual(id,50000)" in text


def test_only_needed_columns_are_read(orders):
    text = plan(settle.settle_full(orders, SETTLED_AT))
    assert "ReadSchema: struct<id:bigint,seller_id:bigint,amount:bigint>" in text


@pytest.mark.parametrize(
    ("rows", "pushed"),
    [
        (lambda o: scans.full_read(o), "GreaterThan(id,0)"),
        (lambda o: scans.confirmed_scan(o), "EqualTo(status,CONFIRMED)"),
        (lambda o: scans.id_range_scan(o, 5, 9), "GreaterThanOrEqual(id,5), LessThanOrEqual(id,9)"),
        (lambda o: pages.keyset_page(o, 7, 5, bits=4), "GreaterThan(id,7), LessThanOrEqual(id,23)"),
        (lambda o: pages.keyset_page(o, 7, 50, bits=4), "LessThanOrEqual(id,263)"),
        (
            lambda o: pages.offset_page(o, 3, 5, bits=4),
            "GreaterThanOrEqual(id,16), LessThanOrEqual(id,31)",
        ),
    ],
)
def test_filters_reach_the_parquet_reader(orders, rows, pushed):
    formatted = rows(orders)._jdf.queryExecution().explainString(
        orders.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert pushed in formatted


def test_keyset_pages_are_plain_inside_their_window(orders):
    for rows in (pages.keyset_page(orders, 7, 50), pages.keyset_page(orders, 7, 50, upto=70)):
        text = plan(rows)
        assert "TakeOrderedAndProject" in text
        assert "Exchange" not in text and "Join" not in text and "Window" not in text


def test_fixture_bounds_reach_the_parquet_reader(spark):
    text = plan(fixtures.orders(spark, FOLDER, after=5, upto=9))
    assert "GreaterThan(o_orderkey,4), LessThanOrEqual(o_orderkey,8)" in text


def test_inserting_joins_with_earlier_settlements_before_it_numbers(spark):
    text = plan(QUERIES["insert_settlements"](spark, FOLDER))
    assert "LeftAnti" not in text  # it ran once, and its rows were put down


def test_aggregates_combine_before_the_shuffle(orders):
    assert "partial_sum" in plan(partition_stats(orders))


def test_numbering_shuffles_and_sorts_rows_once(orders):
    spark = orders.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(number_rows(orders, bits=10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the left side of the offsets join, down to its scan
    rows = text.split("SortMergeJoin [bucket", 1)[1].split("FileScan", 1)[0]
    assert rows.count("Exchange hashpartitioning(bucket") == 1
    assert rows.count("Sort [bucket") == 1


@pytest.mark.parametrize("join", [settle.unsettled_orders, mutations.settle_orders])
def test_key_joins_shuffle_each_side_once_and_combine_keys_first(orders, join):
    spark = orders.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(join(orders, settle.settlement_projection(orders)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning(id") == 2
    keys = text.split("Exchange hashpartitioning(id")[2]
    assert keys.split("HashAggregate(keys=[id", 1)[1].count("Scan") == 1
    assert "SortMergeJoin" in text


def test_upsert_meets_in_one_full_join(orders):
    incoming = orders.filter(F.col("id") < 10)
    text = plan(mutations.upsert_orders(orders, incoming))
    assert text.count("FullOuter") == 1 and "Broadcast" not in text
