"""Dense numbering and pages against sorting in Python, over awkward id sets."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyspark.operators.numbering import bucket_offsets, chunk_numbers, number_rows
from tallyspark.operators.pages import keyset_page, offset_page
from tallyspark.schema import CONFIRMED

LOWEST, HIGHEST = -(2**63), 2**63 - 1

ID_SETS = {
    "dense": list(range(1, 400)),
    "sparse": random.Random(1).sample(range(-(10**15), 10**15), 300),
    "clusters": [c * 10**9 + i for c in (-2, 0, 5) for i in range(90)],
    "groups": [c * 2**44 + i * 2**21 for c in (-3, 0, 1, 7) for i in range(20)],
    "extremes": [LOWEST, LOWEST + 1, -1, 0, 1, HIGHEST - 1, HIGHEST],
    "one": [42],
    "none": [],
}


@pytest.fixture(params=sorted(ID_SETS))
def ids(request):
    return ID_SETS[request.param]


@pytest.fixture(params=[3, 10, 20])
def bits(request):
    return request.param


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_numbers_are_dense_in_id_order(spark, ids, bits):
    rows = number_rows(frame(spark, ids), bits=bits).collect()
    assert {r.id: r.row_no for r in rows} == {i: n for n, i in enumerate(sorted(ids), 1)}
    assert len(rows) == len(ids)


def test_bucket_bounds(spark):
    offsets = bucket_offsets(frame(spark, ID_SETS["clusters"]), bits=4).orderBy("bucket").collect()
    before = 0
    for row in offsets:
        assert row.rows_before == before
        assert 1 <= row.bucket_rows <= 16
        before += row.bucket_rows
    assert before == 270


def test_all_chunks_full_but_the_last(spark):
    chunks = chunk_numbers(frame(spark, ID_SETS["dense"]), size=100, bits=5)
    sizes = {r.chunk_no: r["count"] for r in chunks.groupBy("chunk_no").count().collect()}
    assert sizes == {1: 100, 2: 100, 3: 100, 4: 99}


@pytest.mark.parametrize(("page", "size"), [(0, 1), (3, 7), (2, 100), (10**12, 7)])
def test_offset_page(spark, ids, page, size):
    got = [r.id for r in offset_page(frame(spark, ids), page, size, bits=5).collect()]
    assert got == sorted(ids)[page * size : page * size + size]


@pytest.mark.parametrize(
    ("after", "upto"), [(-1, None), (0, 250), (200, None), (5 * 10**9, None), (HIGHEST, None)]
)
def test_keyset_page(spark, ids, after, upto):
    got = [r.id for r in keyset_page(frame(spark, ids), after, 60, upto, bits=5).collect()]
    last = HIGHEST if upto is None else upto
    assert got == sorted(i for i in ids if after < i <= last)[:60]


def test_keyset_pages_walk_the_table_once(spark):
    table, cursor, seen = frame(spark, ID_SETS["dense"]), 0, []
    while page := [r.id for r in keyset_page(table, cursor, 150, bits=6).collect()]:
        seen += page
        cursor = page[-1]
    assert seen == ID_SETS["dense"]


def test_page_keeps_whole_orders(make_orders):
    orders = make_orders(*[(i, i * 10) for i in range(1, 50)])
    rows = offset_page(orders, 2, 10, bits=3).collect()
    assert [(r.id, r.amount, r.status) for r in rows] == [
        (i, i * 10, CONFIRMED) for i in range(21, 31)
    ]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    ids=st.sets(st.integers(LOWEST, HIGHEST) | st.integers(-50, 50), max_size=60),
    bits=st.integers(1, 30),
)
def test_any_ids_are_numbered(spark, ids, bits):
    rows = number_rows(frame(spark, ids), bits=bits).collect()
    assert sorted((r.row_no, r.id) for r in rows) == list(enumerate(sorted(ids), 1))
