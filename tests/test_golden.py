"""Fixed totals over the given orders, per scale factor."""

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from tallyspark.operators.numbering import chunk_numbers
from tallyspark.operators.ranges import range_partitions
from tallyspark.operators.scans import confirmed_scan
from tallyspark.operators.settle import settlement_projection
from tallyspark.sources import fixtures

# rows, amount, fee, net, least, most, sellers
ALL = {
    "sf0.001": (1_500, 37444679161, 1123339647, 36321339514, 132051, 49970505, 150),
    "sf0.01": (15_000, 375843962006, 11275311406, 364568650600, 101370, 49997859, 1_500),
    "sf0.1": (150_000, 3752339125856, 112570099503, 3639769026353, 100191, 49999318, 14_999),
}
# rows, amount, fee, first id, last id, chunks
CONFIRMED = {
    "sf0.001": (1_007, 25162995832, 754889384, 3, 1_499, 2),
    "sf0.01": (10_067, 252526906832, 7575802207, 1, 14_999, 11),
    "sf0.1": (100_290, 2509846535410, 75295346281, 1, 150_000, 101),
}


@pytest.fixture(params=sorted(ALL))
def scale(request):
    return request.param


def test_all_orders(spark, scale):
    rows = settlement_projection(fixtures.orders(spark, f"{TESTDATA}/{scale}"))
    totals = rows.agg(
        F.count("*"), F.sum("amount"), F.sum("fee"), F.sum("net_amount"),
        F.min("amount"), F.max("amount"), F.countDistinct("seller_id"),
    )
    assert tuple(totals.first()) == ALL[scale]


def test_confirmed_orders(spark, scale):
    orders = confirmed_scan(fixtures.orders(spark, f"{TESTDATA}/{scale}"))
    rows = settlement_projection(orders)
    totals = rows.agg(
        F.count("*"), F.sum("amount"), F.sum("fee"), F.min("order_id"), F.max("order_id")
    )
    chunks = chunk_numbers(orders.select("id"), bits=10).agg(F.max("chunk_no"))
    assert (*totals.first(), *chunks.first()) == CONFIRMED[scale]


def test_ranges(spark):
    ranges = range_partitions(fixtures.orders(spark, f"{TESTDATA}/sf0.01")).orderBy("partition_no")
    assert [(r.min_id, r.max_id) for r in ranges.collect()] == [
        (1, 3_750), (3_751, 7_500), (7_501, 11_250), (11_251, 14_999),
    ]
