"""Analytics over the run log (one row per step) and chunk timings (one row per chunk)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.schema import COMPLETED, FAILED

# The case pairs compared on each axis, plain form first.
CASE_PAIRS = (
    ("reader", "reader-offset", "reader-zero-offset"),
    ("writer", "writer-jpa", "writer-jdbc-batch"),
    ("insert", "insert-identity", "insert-jdbc-rewrite"),
    ("parallel", "sequential", "partitioning"),
)

LOG_EVERY = 100


def step_totals(steps: DataFrame) -> DataFrame:
    """Counters per case. Worker steps (``name:partitionN``) are in their master's sums."""
    return (
        steps.filter(~F.col("step_name").contains(":"))
        .groupBy("case_name")
        .agg(
            *[
                F.sum(c).alias(f"total_{c.removesuffix('_count')}")
                for c in ("read_count", "write_count", "skip_count")
            ],
            F.sum("duration_ms").alias("duration_ms"),
        )
    )


def _per_second(totals: DataFrame) -> DataFrame:
    rate = F.try_divide(F.col("total_read") * F.lit(1000.0), F.col("duration_ms"))
    return totals.withColumn(
        "rows_per_second", F.when(F.col("total_read") > 0, rate).otherwise(F.lit(0.0))
    )


def throughput(steps: DataFrame) -> DataFrame:
    """Rows read per second of each case: 0 when none were, null when no time passed."""
    return _per_second(step_totals(steps)).select(
        "case_name", F.round("rows_per_second", 2).alias("rows_per_second")
    )


def run_report(steps: DataFrame) -> DataFrame:
    """Totals per case as text: grouped thousands, seconds to one place, whole rows/s."""
    grouped = [F.format_number(c, 0).alias(c) for c in ("total_read", "total_write", "total_skip")]
    seconds = F.round(F.col("duration_ms") / F.lit(1000.0), 1)
    return _per_second(step_totals(steps)).select(
        "case_name",
        *grouped,
        F.concat(F.format_number(seconds, 1), F.lit("s")).alias("total_duration"),
        F.concat(
            F.format_number(F.round("rows_per_second", 0), 0), F.lit(" records/s")
        ).alias("throughput"),
    )


def status_report(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """``run_report`` with what became of each case: one that failed in any of its runs has
    failed, also where it has no steps to report; one without a job row has no status."""
    failed = F.bool_or(F.col("status") == FAILED)
    outcome = jobs.groupBy("case_name").agg(F.when(failed, FAILED).otherwise(COMPLETED).alias("status"))
    return run_report(steps).join(outcome, "case_name", "full")


def case_speedup(steps: DataFrame) -> DataFrame:
    """How many times faster the improved case of each pair reads than the plain one."""
    case = F.col("case_name")
    axis = F.coalesce(*[F.when(case.isin(pair), F.lit(name)) for name, *pair in CASE_PAIRS])

    def rate(cases: list[str]):
        return F.max(F.when(case.isin(cases), F.col("rows_per_second")))

    return (
        _per_second(step_totals(steps))
        .groupBy(axis.alias("axis"))
        .agg(
            rate([plain for _, plain, _ in CASE_PAIRS]).alias("base"),
            rate([improved for _, _, improved in CASE_PAIRS]).alias("opt"),
        )
        .filter(F.col("axis").isNotNull())
        .select(
            "axis",
            F.round("base", 2).alias("base_rows_per_second"),
            F.round("opt", 2).alias("opt_rows_per_second"),
            F.round(F.try_divide("opt", "base"), 2).alias("speedup"),
        )
    )


def chunk_timing_by_step(timings: DataFrame) -> DataFrame:
    """Timer per step: number of chunks, total and longest time."""
    return timings.groupBy("step").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.round(F.sum("elapsed_ms"), 2).alias("total_ms"),
        F.max("elapsed_ms").alias("max_ms"),
    )


def chunk_first_latest(timings: DataFrame) -> DataFrame:
    """Time of the first and of the latest chunk, over all steps."""
    return timings.agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.min_by("elapsed_ms", "chunk_no").alias("first_ms"),
        F.max_by("elapsed_ms", "chunk_no").alias("latest_ms"),
    )


def chunk_timing_samples(timings: DataFrame, every: int = LOG_EVERY) -> DataFrame:
    """Each ``every``-th chunk next to the first one's time."""
    first = timings.agg(F.min_by("elapsed_ms", "chunk_no")).scalar()
    return timings.filter(F.col("chunk_no") % every == 0).select(
        "chunk_no",
        "step",
        "elapsed_ms",
        first.alias("first_ms"),
        F.col("elapsed_ms").alias("latest_ms"),
    )
