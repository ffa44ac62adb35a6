"""Run-log analytics on hand-written steps and chunk timings."""

import pytest

from tallyspark.__main__ import main
from tallyspark.operators.runlog import (
    case_speedup,
    chunk_first_latest,
    chunk_timing_by_step,
    chunk_timing_samples,
    run_report,
    status_report,
    step_totals,
    throughput,
)
from tallyspark.plans.audited import ConstraintViolation
from tallyspark.schema import JOB_EXECUTIONS, STEP_EXECUTIONS
from tallyspark.sources.tables import read_batches, write_version


@pytest.fixture
def steps(spark):
    return spark.createDataFrame(
        [
            ("sequential", "step", 1_000_000, 999_990, 10, 40_300),
            ("partitioning", "masterStep", 1_000_000, 1_000_000, 0, 15_650),
            ("partitioning", "workerStep:partition0", 600_000, 600_000, 0, 15_000),
            ("partitioning", "workerStep:partition1", 400_000, 400_000, 0, 14_000),
            ("reader-offset", "step", 0, 0, 0, 0),
            ("reader-zero-offset", "step", 5, 5, 0, 0),
        ],
        STEP_EXECUTIONS,
    )


def by_case(rows):
    return {r.case_name: r for r in rows.collect()}


def test_workers_are_not_counted_again(steps):
    assert by_case(step_totals(steps))["partitioning"].total_read == 1_000_000


def test_throughput(steps):
    rates = by_case(throughput(steps))
    assert rates["sequential"].rows_per_second == pytest.approx(24_813.90)
    assert rates["reader-offset"].rows_per_second == 0
    assert rates["reader-zero-offset"].rows_per_second is None


def test_report(steps):
    row = by_case(run_report(steps))
    assert tuple(row["sequential"]) == (
        "sequential", "1,000,000", "999,990", "10", "40.3s", "24,814 records/s",
    )
    assert row["partitioning"].total_duration == "15.7s"
    assert row["reader-offset"].throughput == "0 records/s"


def test_speedup(steps):
    rows = {r.axis: r for r in case_speedup(steps).collect()}
    assert rows["parallel"].speedup == pytest.approx(2.58)
    assert rows["reader"].speedup is None


def test_chunk_timings(spark):
    timings = spark.createDataFrame(
        [("a" if n % 2 else "b", n, float(1_000 - n)) for n in range(1, 251)],
        "step string, chunk_no long, elapsed_ms double",
    )
    assert tuple(chunk_first_latest(timings).first()) == (250, 999.0, 750.0)
    assert sorted(tuple(r) for r in chunk_timing_samples(timings).collect()) == [
        (100, "b", 900.0, 999.0, 900.0),
        (200, "b", 800.0, 999.0, 800.0),
    ]
    per_step = {r.step: tuple(r)[1:] for r in chunk_timing_by_step(timings).collect()}
    assert per_step["a"] == (125, sum(1_000.0 - n for n in range(1, 251, 2)), 999.0)


def test_status_of_each_case(spark, steps):
    jobs = [("sequential", "COMPLETED"), ("partitioning", "COMPLETED"), ("partitioning", "FAILED"), ("writer-jpa", "FAILED")]
    rows = by_case(status_report(steps, spark.createDataFrame(jobs, JOB_EXECUTIONS)))
    found = {name: (row["status"], row["total_read"]) for name, row in rows.items()}
    assert found == {
        "sequential": ("COMPLETED", "1,000,000"),
        "partitioning": ("FAILED", "1,000,000"),
        "writer-jpa": ("FAILED", None),
        "reader-offset": (None, "0"),
        "reader-zero-offset": (None, "5"),
    }


def test_a_failed_case_is_on_record(spark, make_orders, tmp_path):
    write_version(make_orders((1, 1), (1, 2)), f"{tmp_path}/orders")
    with pytest.raises(ConstraintViolation):
        main([str(tmp_path), "reader-zero-offset", "sequential"])
    jobs = read_batches(spark, f"{tmp_path}/jobs", JOB_EXECUTIONS).collect()
    assert sorted(map(tuple, jobs)) == [("reader-zero-offset", "COMPLETED"), ("sequential", "FAILED")]
