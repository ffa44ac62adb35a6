"""Offset pages through a stored index."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import page_index
from tallyspark.schema import ORDERS
from tallyspark.sources import tables
from tallyspark.sources.fixtures import SETTLED_AT
from tallyspark.sources.generate import generate_orders


def page_ids(spark, root, page, size):
    found = page_index.indexed_page(spark, root, "confirmed", page_index.confirmed(), page, size)
    return [r["id"] for r in found.collect()]


def refresh(spark, root, bits=3):
    return page_index.refresh(spark, root, "confirmed", page_index.confirmed(), bits=bits)


def index_rows(spark, place):
    rows = tables.read_table(spark, place, page_index.INDEX).filter("first_id IS NOT NULL")
    return sorted(tuple(r)[:4] for r in rows.collect())


def test_every_page_of_a_growing_table(spark, make_orders, tmp_path):
    """Appends above, inside and below the ids counted before, some without a confirmed order."""
    root, draw = f"{tmp_path}/orders", random.Random(3)
    pool = draw.sample(range(-50, 400), 120)
    kept = []
    for part in (sorted(pool)[40:60], sorted(pool)[60:90], sorted(pool)[90:100], sorted(pool)[:40], sorted(pool)[100:]):
        rows = [(i, 5, draw.choice(["CONFIRMED", "CONFIRMED", "SETTLED"])) for i in part]
        if part[0] == sorted(pool)[90]:
            rows = [(i, 5, "SETTLED") for i in part]
        kept = sorted(kept + [i for i, _, status in rows if status == "CONFIRMED"])
        tables.append_rows(make_orders(*rows), root)
        with pytest.raises(ValueError, match="not up to date"):
            page_ids(spark, root, 0, 7)
        place = refresh(spark, root)
        assert place == refresh(spark, root)
        spans = index_rows(spark, place)
        assert all(a[1] < b[0] and a[3] == b[2] for a, b in zip(spans, spans[1:]))
        for page in (0, 1, len(kept) // 7, len(kept) // 7 + 1):
            assert page_ids(spark, root, page, 7) == kept[page * 7 : page * 7 + 7]


def test_an_append_above_counts_only_itself(spark, make_orders, tmp_path):
    root = f"{tmp_path}/orders"
    tables.append_rows(make_orders((1, 1), (2, 1), (9, 1)), root)
    place = refresh(spark, root)
    tables.append_rows(make_orders((10, 1), (40, 1)), root)
    refresh(spark, root)
    # the bucket of ids 8 to 15 goes on behind id 9
    assert index_rows(spark, place) == [(0, 7, 0, 2), (8, 9, 2, 3), (10, 15, 3, 4), (40, 40, 4, 5)]
    assert tables.latest_version(spark, place) == 0
    tables.append_rows(make_orders((5, 1)), root)
    refresh(spark, root)
    assert tables.latest_version(spark, place) == 1


def test_a_new_version_has_no_index_yet(spark, make_orders, tmp_path):
    root = f"{tmp_path}/orders"
    with pytest.raises(ValueError):
        refresh(spark, root)
    tables.write_version(make_orders((1, 1)), root)
    refresh(spark, root)
    tables.write_version(make_orders((2, 1)), root)
    with pytest.raises(ValueError, match="not up to date"):
        page_ids(spark, root, 0, 5)
    refresh(spark, root)
    assert page_ids(spark, root, 0, 5) == [2]
    tables.write_version(spark.createDataFrame([], ORDERS), root)
    refresh(spark, root)
    assert page_ids(spark, root, 0, 5) == []


def scanned_rows(plan):
    """Rows that the scans of an executed plan gave."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scanned_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return scanned_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if name == "FileSourceScanExec" else 0
    children = plan.children()
    return own + sum(scanned_rows(children.apply(i)) for i in range(children.size()))


def test_a_deep_page_reads_no_more_rows_than_an_early_one(spark, tmp_path):
    root = f"{tmp_path}/orders"
    made = generate_orders(spark, 400_000, SETTLED_AT).coalesce(4)
    tables.write_version(made, root, {"parquet.block.size": "65536", "parquet.page.size": "8192"})
    refresh(spark, root, bits=11)
    seen = {}
    for page in (5, 100, 399):
        rows = page_index.indexed_page(spark, root, "confirmed", page_index.confirmed(), page)
        assert rows.agg(F.min("id"), F.max("id")).first() == (page * 1000 + 1, page * 1000 + 1000)
        rows.collect()
        seen[page] = scanned_rows(rows._jdf.queryExecution().executedPlan())
    # the row groups that a page and its bucket lie in, of some 2,500 rows each
    assert max(seen.values()) < 8_000
