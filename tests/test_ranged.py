"""Updates that rewrite only the ranges they touch."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.mutations import settle_orders, upsert_orders
from tallyspark.plans import ranged
from tallyspark.sources.fixtures import SETTLED_AT
from tallyspark.sources.generate import generate_orders


@pytest.fixture
def stored(spark, tmp_path):
    root = str(tmp_path / "orders")
    ranged.write_ranged(generate_orders(spark, 100, SETTLED_AT), root, bits=4)
    return root


def files(root):
    """Data files by the number of their range."""
    found = {}
    for part in Path(root, "rows").glob(f"{ranged.RANGE}=*"):
        names = sorted(p.name for p in part.glob("*.parquet"))
        found[int(part.name.split("=")[1])] = names
    return found


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "order_id long")


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_untouched_files_keep_their_names(spark, stored):
    before, orders = files(stored), rows(ranged.read_ranged(spark, stored))
    keys = ids(spark, 17, 18, 18, 90, None, 5_000)
    expected = rows(settle_orders(ranged.read_ranged(spark, stored), keys))
    ranged.settle_in_place(spark, stored, keys, bits=4)
    after = files(stored)
    assert {n for n in before if before[n] != after[n]} == {1, 5}
    assert set(after) == set(before)
    assert rows(ranged.read_ranged(spark, stored)) == expected != orders


def test_only_touched_ranges_are_read(spark, stored, monkeypatch):
    seen = []

    def change(rows):
        rows.collect()
        seen.append(rows._jdf.queryExecution().executedPlan())
        return rows

    ranged.update_ranges(spark, stored, ids(spark, 33).toDF("id"), change, 4)
    (scan,) = (seen[0].collectLeaves().apply(i) for i in range(seen[0].collectLeaves().size()))
    assert scan.metrics().apply("numPartitions").value() == 1
    assert scan.metrics().apply("numOutputRows").value() == 16
    monkeypatch.setattr(ranged, "NAMED_RANGES", 1)
    ranged.settle_in_place(spark, stored, ids(spark, 1, 20, 40), bits=4)
    assert ranged.read_ranged(spark, stored).filter("status = 'SETTLED'").count() == 3


def test_upserts_may_open_new_ranges(spark, stored, make_orders):
    incoming = make_orders((3, 1), (300, 2), (-5, 3))
    expected = rows(upsert_orders(ranged.read_ranged(spark, stored), incoming))
    before = files(stored)
    ranged.upsert_in_place(spark, stored, incoming, bits=4)
    assert rows(ranged.read_ranged(spark, stored)) == expected
    after = files(stored)
    assert set(after) - set(before) == {18, -1}
    assert {n for n in before if before[n] != after[n]} == {0}


def test_nothing_to_update(spark, stored):
    before = files(stored)
    ranged.settle_in_place(spark, stored, ids(spark), bits=4)
    assert files(stored) == before


@pytest.mark.parametrize("lost_after", ["nothing", "one range"])
def test_a_run_lost_while_ranges_are_replaced(spark, stored, monkeypatch, lost_after):
    keys = ids(spark, 1, 40, 80)
    expected = rows(settle_orders(ranged.read_ranged(spark, stored), keys))

    def lost(spark, root, schema=None):
        if lost_after == "one range" and ranged.exists(spark, f"{root}/pending/_SUCCESS"):
            # the commit has removed a range and not yet put its next files there
            ranged.remove(spark, f"{root}/rows/{ranged.RANGE}=2")
        if ranged.exists(spark, f"{root}/pending/_SUCCESS"):
            raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(ranged, "finish_pending", lost)
        with pytest.raises(RuntimeError):
            ranged.settle_in_place(spark, stored, keys, bits=4)
    assert rows(ranged.read_ranged(spark, stored)) == expected
    assert not ranged.finish_pending(spark, stored)


def test_a_run_lost_before_its_change_is_complete(spark, stored):
    before = rows(ranged.read_ranged(spark, stored))
    failing = F.raise_error(F.lit("lost")).cast("string")
    with pytest.raises(Exception, match="lost"):
        ranged.update_ranges(
            spark, stored, ids(spark, 1).toDF("id"), lambda r: r.withColumn("status", failing), bits=4
        )
    assert rows(ranged.read_ranged(spark, stored)) == before
