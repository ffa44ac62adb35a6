"""Fee arithmetic and id ranges on hand-written rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from tallyspark.functions.money import fee, net_amount
from tallyspark.operators.ranges import (
    assign_ranges,
    confirmed_bounds,
    partition_stats,
    range_partitions,
)
from tallyspark.operators.settle import settle_ranged
from tallyspark.schema import SETTLED
from tallyspark.sources.fixtures import SETTLED_AT


@pytest.mark.parametrize(
    ("amount", "expected"),
    [(0, 0), (33, 0), (34, 1), (99, 2), (100, 3), (-50, -1), (-33, 0), (100_000, 3_000)],
)
def test_fee_truncates_toward_zero(spark, amount, expected):
    row = spark.range(1).select(
        fee(F.lit(amount).cast("long")).alias("fee"),
        net_amount(F.lit(amount).cast("long")).alias("net"),
    )
    assert tuple(row.first()) == (expected, amount - expected)
    assert [f.dataType.simpleString() for f in row.schema] == ["bigint", "bigint"]


def test_fee_overflow_raises(spark):
    with pytest.raises(ArithmeticException, match="ARITHMETIC_OVERFLOW"):
        spark.range(1).select(fee(F.col("id") + F.lit(2**63 - 1))).collect()


@pytest.mark.parametrize(
    ("ids", "expected"),
    [
        ((1, 5), [(1, 2), (3, 4), (5, 5), (7, 5)]),
        ((1, 1), [(1, 1), (2, 1), (3, 1), (4, 1)]),
        ((1, 10), [(1, 3), (4, 6), (7, 9), (10, 10)]),
        ((-7, 8), [(-7, -4), (-3, 0), (1, 4), (5, 8)]),
    ],
)
def test_ranges(make_orders, ids, expected):
    rows = range_partitions(make_orders(*[(i, 100) for i in ids])).orderBy("partition_no")
    assert [(r.min_id, r.max_id) for r in rows.collect()] == expected
    assert [r.label for r in rows.collect()] == [f"partition{i}" for i in range(4)]


def test_every_order_falls_into_the_range_that_contains_it(make_orders):
    orders = make_orders(*[(i, 100) for i in range(3, 60, 2)])
    ranges = {r.partition_no: r for r in range_partitions(orders, 7).collect()}
    for row in assign_ranges(orders, 7).collect():
        home = ranges[row.partition_no]
        assert home.min_id <= row.id <= home.max_id


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    low=st.integers(-(10**12), 10**12),
    span=st.integers(0, 10**12) | st.integers(0, 9),
    grid=st.integers(1, 40),
)
def test_ranges_are_disjoint_and_cover_the_bounds(make_orders, low, span, grid):
    orders = make_orders((low, 1), (low + span, 1))
    ranges = [(r.min_id, r.max_id) for r in range_partitions(orders, grid).collect()]
    assert len(ranges) == grid
    filled = sorted(r for r in ranges if r[0] <= r[1])
    assert filled[0][0] == low and filled[-1][1] == low + span
    assert all(before[1] + 1 == after[0] for before, after in zip(filled, filled[1:]))


def test_no_confirmed_orders_means_no_ranges_and_no_rows(make_orders):
    orders = make_orders((1, 100, SETTLED), (2, 100, SETTLED))
    assert tuple(confirmed_bounds(orders).first()) == (None, None)
    assert range_partitions(orders).count() == 0
    assert partition_stats(orders).count() == 0
    assert settle_ranged(orders, SETTLED_AT).count() == 0


def test_bounds_are_from_confirmed_orders_but_ranges_hold_every_status(make_orders):
    orders = make_orders((1, 1, SETTLED), (2, 1), (3, 1, SETTLED), (4, 1), (5, 1, SETTLED))
    assert sorted(r.order_id for r in settle_ranged(orders, SETTLED_AT).collect()) == [2, 3, 4]
