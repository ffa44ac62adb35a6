"""Updates and upserts as set operations that yield the next state of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.schema import CONFIRMED, SETTLED


def reset_orders(orders: DataFrame) -> DataFrame:
    """Every order back to confirmed."""
    return orders.withColumn("status", F.lit(CONFIRMED))


def settle_orders(orders: DataFrame, keys: DataFrame, key: str = "order_id") -> DataFrame:
    """Orders after ``status = SETTLED`` for each id in ``keys``.

    Distinct keys keep one row per order and collapse a repeated key before the shuffle;
    AQE turns the join into a broadcast when the keys prove small at run time.
    """
    settled = keys.select(F.col(key).alias("id")).distinct().withColumn("is_settled", F.lit(True))
    status = F.when(F.col("is_settled"), F.lit(SETTLED)).otherwise(F.col("status"))
    return orders.join(settled, "id", "left").withColumn("status", status).select(orders.columns)


def latest_per_id(rows: DataFrame, sequence: str) -> DataFrame:
    """Of several rows with one id the one with the highest ``sequence``; of equal ones the one
    with the highest values, column by column, so that runs agree.

    The maximum combines within each map task, so a hot id shuffles as one row per task.
    """
    names = [c for c in rows.columns if c not in ("id", sequence)]
    return (
        rows.groupBy("id")
        .agg(F.max(F.struct(sequence, *names)).alias("latest"))
        .select("id", *[F.col("latest")[c].alias(c) for c in names])
    )


def _merged(joined: DataFrame, columns: list[str], was: str, came: str) -> DataFrame:
    matched = F.col(f"{came}.id").isNotNull()
    existed = F.col(f"{was}.id").isNotNull()

    def value(name: str):
        old, new = F.col(f"{was}.{name}"), F.col(f"{came}.{name}")
        if name == "created_at":
            return F.when(existed, old).otherwise(new).alias(name)
        return F.when(matched, new).otherwise(old).alias(name)

    return joined.select([value(c) for c in columns])


def upsert_orders(
    orders: DataFrame, incoming: DataFrame, sequence: str | None = None
) -> DataFrame:
    """Orders after merging ``incoming`` by id: update where present, else insert.

    ``created_at`` of an existing order never changes. ``sequence`` orders several
    versions of one id; without it ids in ``incoming`` are taken to be unique.

    Both sides meet in one full outer join, whatever their sizes. An incoming row without an
    id raises an error.
    """
    missing = F.raise_error(F.lit("an incoming order has no id")).cast("long")
    incoming = incoming.withColumn("id", F.coalesce("id", missing))
    latest = latest_per_id(incoming, sequence) if sequence else incoming
    was, came = orders.alias("was"), latest.alias("came")
    same_id = F.col("was.id") == F.col("came.id")
    return _merged(was.join(came, same_id, "full"), orders.columns, "was", "came")
