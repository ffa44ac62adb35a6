"""Appends that are audited before anybody sees them."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.settle import newly_arrived, settled_among
from tallyspark.plans import append, audited
from tallyspark.plans.cases import run_case
from tallyspark.schema import ORDERS, SETTLEMENTS
from tallyspark.sources import tables
from tallyspark.sources.fixtures import SETTLED_AT

FACTS = "id long, order_id long, seller_id long, amount long, fee long, net_amount long"


@pytest.fixture
def settled(spark):
    """Settlements of the given order ids; None stands for a missing seller."""

    def make(*order_ids, seller=7):
        rows = [(n, order_id, seller, 100, 3, 97) for n, order_id in enumerate(order_ids, 1)]
        frame = spark.createDataFrame(rows, FACTS)
        return frame.withColumn("settled_at", F.lit(SETTLED_AT.isoformat(" ")).cast("timestamp_ntz"))

    return make


def visible(spark, folder):
    rows = tables.read_batches(spark, folder, SETTLEMENTS).collect()
    return sorted(r["order_id"] for r in rows)


def test_a_good_batch_is_published(spark, settled, tmp_path):
    audit = audited.audited_append(settled(1, 2, 3), f"{tmp_path}", 0)
    assert audit.published and audit.row() == (0, 3, 0, 0, 0, True)
    assert visible(spark, str(tmp_path)) == [1, 2, 3]


def test_a_duplicate_fails_the_whole_batch(spark, settled, tmp_path):
    folder = str(tmp_path)
    audited.audited_append(settled(1, 2), folder, 0)
    with pytest.raises(audited.ConstraintViolation, match="1 orders settled twice") as refused:
        audited.audited_append(settled(3, 4, 4, 4), folder, 1)
    assert refused.value.audit.examples == (4,)
    assert visible(spark, folder) == [1, 2] and not (tmp_path / "batch_id=1").exists()
    audited.audited_append(settled(3, 4), folder, 1)
    assert visible(spark, folder) == [1, 2, 3, 4]


def test_an_order_settled_before_fails_the_batch(spark, settled, tmp_path):
    folder = str(tmp_path)
    audited.audited_append(settled(*range(1, 50)), folder, 0)
    earlier = tables.read_batches(spark, folder, SETTLEMENTS)
    with pytest.raises(audited.ConstraintViolation) as refused:
        audited.audited_append(settled(48, 49, 50, 51), folder, 1, earlier)
    assert refused.value.audit.row() == (1, 4, 0, 0, 2, False)
    assert refused.value.audit.examples == (48, 49)
    assert visible(spark, folder) == list(range(1, 50))


def test_missing_values_fail_the_batch(spark, settled, tmp_path):
    with pytest.raises(audited.ConstraintViolation, match="'seller_id': 2"):
        audited.audited_append(settled(1, None, seller=None), str(tmp_path), 0, settled(1))
    assert visible(spark, str(tmp_path)) == []
    assert audited.tried_append(settled(None, None), str(tmp_path), 0, settled(1)).row() == (0, 2, 2, 0, 0, False)


def test_an_empty_batch_is_published(spark, settled, tmp_path):
    assert audited.audited_append(settled(1).limit(0), str(tmp_path), 0, settled(1)).published


def test_a_run_lost_before_publishing_is_repeated(spark, settled, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(audited, "publish_batch", lost)
        with pytest.raises(RuntimeError):
            audited.audited_append(settled(1, 2), folder, 0)
    assert visible(spark, folder) == [] and tables.next_batch(spark, folder) == 0
    audited.audited_append(settled(1, 2, 3), folder, 0)
    assert visible(spark, folder) == [1, 2, 3]


def test_appends_and_cases_refuse_an_order_held_twice(spark, make_orders, tmp_path):
    folder = str(tmp_path)
    tables.write_version(make_orders((1, 10), (2, 20), (2, 30)), f"{folder}/orders")
    with pytest.raises(audited.ConstraintViolation):
        append.append_new_settlements(spark, folder, SETTLED_AT)
    with pytest.raises(audited.ConstraintViolation):
        run_case(spark, "sequential", folder, SETTLED_AT)
    assert append.appended_settlements(spark, folder).count() == 0
    assert {r["status"] for r in tables.read_table(spark, f"{folder}/orders", ORDERS).collect()} == {"CONFIRMED"}


@pytest.fixture
def shuffled_joins(spark):
    """Joins as with sides beyond any broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def shuffled_rows(plan):
    """Rows written by each exchange of an executed plan."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    own = []
    if name == "ShuffleExchangeExec":
        own.append(plan.metrics().apply("shuffleRecordsWritten").value())
    children = plan.children()
    return own + [n for i in range(children.size()) for n in shuffled_rows(children.apply(i))]


def test_shuffled_rows_follow_the_arrivals(spark, shuffled_joins, tmp_path):
    history = spark.range(400_000).select(F.col("id").alias("order_id"))
    history.write.parquet(f"{tmp_path}/history")
    spark.range(399_000, 401_000).write.parquet(f"{tmp_path}/arrived")
    arrived = spark.read.parquet(f"{tmp_path}/arrived")
    history = spark.read.parquet(f"{tmp_path}/history")
    new = newly_arrived(arrived, history)
    assert sorted(r["id"] for r in new.collect()) == list(range(400_000, 401_000))
    plan = new._jdf.queryExecution().executedPlan()
    assert "might_contain" in plan.toString()
    assert sum(shuffled_rows(plan)) < 40_000
    assert settled_among(arrived, history).count() == 1_000
