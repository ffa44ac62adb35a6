"""Appends that hold the constraints of settlements: write, audit, publish.

A batch is written without its marker, so nobody sees it. Missing values and repeated keys are
counted while it is written; keys that earlier batches hold are looked up afterwards, with the
earlier ones reduced to the batch's own. Only a batch without a violation gets its marker,
which makes all its rows visible at once. Any other is removed and reported: one settlement
too many fails its whole batch, and what was visible before stays as it was.

A run lost before the marker leaves a batch that does not count; the next append with that
number replaces it.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.constraints import duplicate_settlements
from tallyspark.operators.settle import settled_among
from tallyspark.schema import SETTLEMENTS
from tallyspark.sources.tables import drop_batch, publish_batch, stage_batch, staged_batch

#: How many offending keys a report names.
NAMED = 5

AUDITS = T.StructType(
    [
        T.StructField("batch", T.LongType(), False),
        T.StructField("row_count", T.LongType(), False),
        T.StructField("null_count", T.LongType(), False),
        T.StructField("repeated_keys", T.LongType(), False),
        T.StructField("settled_before", T.LongType(), False),
        T.StructField("published", T.BooleanType(), False),
    ]
)


class Audit(NamedTuple):
    """Counts of one append. Keys count once however often they are repeated; with missing
    values ``settled_before`` is not looked up."""

    batch: int
    row_count: int
    nulls: dict[str, int]
    repeated_keys: int
    settled_before: int
    examples: tuple[int, ...]

    @property
    def published(self) -> bool:
        return not (any(self.nulls.values()) or self.repeated_keys or self.settled_before)

    def row(self) -> tuple:
        nulls = sum(self.nulls.values())
        return (self.batch, self.row_count, nulls, self.repeated_keys, self.settled_before, self.published)


class ConstraintViolation(ValueError):
    """An append that was refused; nothing of it is visible."""

    def __init__(self, audit: Audit):
        self.audit = audit
        nulls = {name: count for name, count in audit.nulls.items() if count}
        super().__init__(
            f"batch {audit.batch} of {audit.row_count} settlements refused: missing values {nulls}, "
            f"{audit.repeated_keys} orders settled twice in it, {audit.settled_before} settled "
            f"before, among them {list(audit.examples)}"
        )


def _repeated(rows: DataFrame) -> DataFrame:
    return duplicate_settlements(rows).select("order_id")


def _first_keys(keys: DataFrame) -> tuple[int, tuple[int, ...]]:
    """How many keys there are, and the smallest few."""
    count = keys.count()
    first = keys.orderBy("order_id").limit(NAMED).collect() if count else []
    return count, tuple(row["order_id"] for row in first)


def stage_and_audit(
    rows: DataFrame,
    folder: str,
    batch: int,
    earlier: DataFrame | None = None,
    repeats: str | None = None,
) -> Audit:
    """Writes settlements as a batch nobody sees and counts what is wrong with them.

    ``repeats`` names a column that tells repeated keys, as ``number_rows`` gives it, and is
    not stored; without it the written keys are counted. ``earlier`` are the settlements that
    are visible; without it they are taken to be others, as after an anti-join.
    """
    spark = rows.sparkSession
    seen = Observation()
    counters = [F.count(F.lit(1)).alias("row_count")]
    counters += [F.count_if(F.col(name).isNull()).alias(name) for name in SETTLEMENTS.names]
    counters += [F.min("order_id").alias("low"), F.max("order_id").alias("high")]
    if repeats:
        counters.append(F.count_if(repeats).alias("repeated"))
    stage_batch(rows.observe(seen, *counters).select(SETTLEMENTS.names), folder, batch)
    counts = seen.get
    nulls = {name: counts[name] for name in SETTLEMENTS.names}
    keys = staged_batch(spark, folder, batch, SETTLEMENTS).select("order_id").filter("order_id IS NOT NULL")
    repeated, before, examples = 0, 0, ()
    if not repeats or counts["repeated"]:
        repeated, examples = _first_keys(_repeated(keys))
    if earlier is not None and counts["low"] is not None and not any(nulls.values()):
        # literal bounds reach the reader: batches of other ids are not read
        near = earlier.filter(F.col("order_id").between(counts["low"], counts["high"]))
        found = settled_among(keys.select(F.col("order_id").alias("id")), near)
        before, known = _first_keys(found.distinct())
        examples = tuple(sorted({*examples, *known})[:NAMED])
    return Audit(batch, counts["row_count"], nulls, repeated, before, examples)


def audited_append(
    rows: DataFrame,
    folder: str,
    batch: int,
    earlier: DataFrame | None = None,
    repeats: str | None = None,
    expected: int | None = None,
) -> Audit:
    """Appends a batch if it holds all constraints; raises ConstraintViolation if not, also
    where it has another number of rows than ``expected``."""
    spark = rows.sparkSession
    audit = stage_and_audit(rows, folder, batch, earlier, repeats)
    if not audit.published or expected not in (None, audit.row_count):
        drop_batch(spark, folder, batch)
        raise ConstraintViolation(audit)
    publish_batch(spark, folder, batch)
    return audit


def tried_append(rows: DataFrame, folder: str, batch: int, earlier: DataFrame | None = None) -> Audit:
    """As ``audited_append``, but a refusal is a result."""
    try:
        return audited_append(rows, folder, batch, earlier)
    except ConstraintViolation as refused:
        return refused.audit


def audit_rows(spark: SparkSession, audits: Iterable[Audit]) -> DataFrame:
    return spark.createDataFrame([audit.row() for audit in audits], AUDITS)
