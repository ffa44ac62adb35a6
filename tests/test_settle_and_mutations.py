"""Settling, updates, upserts and constraints on hand-written rows."""

import datetime as dt

import pytest

from tallyspark.operators.constraints import (
    duplicate_settlements,
    null_violations,
    status_length_violations,
)
from tallyspark.operators.mutations import latest_per_id, reset_orders, settle_orders, upsert_orders
from tallyspark.operators.numbering import number_rows
from tallyspark.operators.scans import confirmed_scan, full_read, id_range_scan, typed_orders
from tallyspark.operators.settle import (
    insert_settlements,
    new_settlements,
    settle_bounded,
    settle_full,
    settle_status,
    unsettled_orders,
)
from tallyspark.schema import CONFIRMED, ORDER_DATE, ORDERS, SETTLED, SETTLEMENTS
from tallyspark.sources.fixtures import SETTLED_AT, SETTLED_BEFORE


@pytest.fixture
def no_settlements(spark):
    return spark.createDataFrame([], SETTLEMENTS)


def ids(rows, column="id"):
    return sorted(r[column] for r in rows.collect())


def test_reads_start_above_the_cursor(make_orders):
    orders = make_orders((-1, 1), (0, 1), (1, 1))
    assert ids(full_read(orders)) == [1]
    assert ids(id_range_scan(orders, -1, 0)) == [-1, 0]


def test_ordered_reads(make_orders):
    orders = make_orders((3, 1), (1, 1), (2, 1, SETTLED))
    assert [r.id for r in full_read(orders, ordered=True).collect()] == [1, 2, 3]
    assert [r.id for r in confirmed_scan(orders, ordered=True).collect()] == [1, 3]


def test_typed_orders_narrows_sql_types(spark):
    loose = spark.sql(
        "SELECT 1 AS id, 2 AS seller_id, 3 AS amount, 'CONFIRMED' AS status,"
        " TIMESTAMP '2026-03-25 10:00:00' AS order_date,"
        " TIMESTAMP '2026-03-25 10:00:00' AS created_at, 'x' AS extra"
    )
    typed = typed_orders(loose)
    assert [(f.name, f.dataType) for f in typed.schema] == [(f.name, f.dataType) for f in ORDERS]
    assert typed.first().order_date == dt.date(2026, 3, 25)
    assert typed.first().created_at == dt.datetime(2026, 3, 25, 10)


def test_settlement_adds_up_to_the_order(make_orders):
    rows = settle_full(make_orders(*[(i, i * 37) for i in range(1, 200)]), SETTLED_AT).collect()
    assert len(rows) == 199
    for row in rows:
        assert row.amount == row.order_id * 37
        assert row.fee + row.net_amount == row.amount
        assert row.fee == row.amount * 3 // 100
        assert (row.settled_at, row.order_status) == (SETTLED_AT, SETTLED)


def test_bounded_settlement_leaves_orders_confirmed(make_orders):
    orders = make_orders(*[(i, 100) for i in range(-2, 9)])
    rows = settle_bounded(orders, SETTLED_AT, 5).collect()
    assert sorted(r.order_id for r in rows) == [1, 2, 3, 4, 5]
    assert {r.order_status for r in rows} == {CONFIRMED}


def test_status_only_settlement(make_orders):
    rows = settle_status(make_orders((0, 1), (1, 1), (2, 1, SETTLED))).collect()
    assert sorted((r.id, r.status) for r in rows) == [(1, SETTLED), (2, SETTLED)]


def test_insert_numbers_densely_and_goes_on(make_orders, no_settlements):
    first = insert_settlements(make_orders((9, 1), (4, 1)), no_settlements, SETTLED_BEFORE, bits=2)
    assert sorted((r.id, r.order_id) for r in first.collect()) == [(1, 4), (2, 9)]
    orders = make_orders((9, 1), (4, 1), (30, 1), (1, 1))
    second = insert_settlements(orders, first, SETTLED_AT, bits=2)
    assert sorted((r.id, r.order_id) for r in second.collect()) == [(1, 4), (2, 9), (3, 1), (4, 30)]


def test_settling_twice_adds_nothing(make_orders, no_settlements):
    orders = make_orders((1, 1), (2, 1))
    once = insert_settlements(orders, no_settlements, SETTLED_AT)
    assert new_settlements(orders, once, SETTLED_AT).count() == 0
    assert ids(insert_settlements(orders, once, SETTLED_AT)) == [1, 2]


def test_repeated_keys_neither_multiply_nor_hide_orders(spark, make_orders):
    orders = make_orders(*[(i, 1) for i in range(1, 6)])
    keys = spark.createDataFrame([(2,)] * 500 + [(4,), (77,)], "order_id long")
    settled = settle_orders(orders, keys).collect()
    assert sorted((r.id, r.status) for r in settled) == [
        (1, CONFIRMED), (2, SETTLED), (3, CONFIRMED), (4, SETTLED), (5, CONFIRMED),
    ]
    assert ids(unsettled_orders(orders, keys)) == [1, 3, 5]


def test_reset(make_orders):
    assert {r.status for r in reset_orders(make_orders((1, 1, SETTLED), (2, 1))).collect()} == {
        CONFIRMED
    }


def test_upsert_updates_inserts_and_keeps_created_at(spark, make_orders):
    later = dt.datetime(2026, 4, 1)
    incoming = spark.createDataFrame(
        [(2, 5, 50, SETTLED, ORDER_DATE, later), (9, 6, 60, SETTLED, ORDER_DATE, later)], ORDERS
    )
    current = make_orders((1, 10), (2, 20))
    created = current.first().created_at
    rows = upsert_orders(current, incoming).collect()
    assert sorted((r.id, r.seller_id, r.amount, r.status, r.created_at) for r in rows) == [
        (1, 101, 10, CONFIRMED, created),
        (2, 5, 50, SETTLED, created),
        (9, 6, 60, SETTLED, later),
    ]


def test_upsert_takes_the_latest_version_of_a_hot_id(spark, make_orders):
    feed = spark.range(1, 3_001).selectExpr(
        "IF(id % 3 = 0, 7L, id) AS id", "1L AS seller_id", "id AS amount", "'SETTLED' AS status",
        "DATE '2026-03-25' AS order_date", "TIMESTAMP_NTZ '2026-03-25 00:00:00' AS created_at",
        "id AS version",
    )
    merged = upsert_orders(make_orders((7, 0), (5_000, 0)), feed, "version")
    assert merged.filter("id = 7").first().amount == 3_000
    # the 2000 fed ids that 3 does not divide, 7 among them, and the untouched order 5000
    assert merged.count() == merged.select("id").distinct().count() == 2_001


def test_latest_keeps_null_values(spark):
    rows = spark.createDataFrame([(1, "old", 1), (1, None, 2)], "id long, value string, n long")
    assert [tuple(r) for r in latest_per_id(rows, "n").collect()] == [(1, None)]


def test_constraints(spark):
    settlements = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (3,)], "order_id long")
    assert sorted(map(tuple, duplicate_settlements(settlements).collect())) == [(2, 2), (3, 3)]
    rows = spark.createDataFrame(
        [(1, "x" * 20), (2, "y" * 21), (None, None)], "id long, status string"
    )
    nulls = null_violations(rows, ["id", "status"]).collect()
    assert sorted(map(tuple, nulls)) == [("id", 1), ("status", 1)]
    assert [tuple(r) for r in status_length_violations(rows).collect()] == [(2, "y" * 21, 21)]


def test_upsert_refuses_a_row_without_an_id(spark, make_orders):
    incoming = spark.createDataFrame(
        [(None, 5, 50, SETTLED, ORDER_DATE, dt.datetime(2026, 4, 1))],
        "id long, seller_id long, amount long, status string, order_date date, created_at timestamp_ntz",
    )
    with pytest.raises(Exception, match="no id"):
        upsert_orders(make_orders((1, 10)), incoming).collect()


def test_numbering_refuses_a_null_key(spark):
    with pytest.raises(Exception, match="id is null"):
        number_rows(spark.createDataFrame([(1,), (None,)], "id long")).collect()


def test_versions_of_one_sequence_number_are_decided_by_their_values(spark):
    rows = [(1, 7, 100, "A"), (1, 7, 300, "B"), (1, 7, 200, "C"), (1, 6, 900, "D"), (2, None, 5, "E")]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "id long, version long, amount long, status string").repartition(3)
        latest = sorted(tuple(r) for r in latest_per_id(frame, "version").collect())
        assert latest == [(1, 300, "B"), (2, 5, "E")]
