"""The given tables seen as orders, settlements, a feed, a run log and chunk timings.

Ids are keys shifted by one. A filter on a shifted id does not reach the Parquet reader,
so the orders take their bounds as arguments and filter the raw column.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.runlog import CASE_PAIRS
from tallyspark.operators.scans import confirmed_scan
from tallyspark.operators.settle import settlement_projection, stamp
from tallyspark.schema import (
    COMPLETED,
    CONFIRMED,
    FAILED,
    GRID_SIZE,
    JOB_EXECUTIONS,
    SETTLED,
    SETTLEMENTS,
    STEP_EXECUTIONS,
)

SETTLED_AT = dt.datetime(2026, 3, 25)
SETTLED_BEFORE = dt.datetime(2026, 3, 24)

RAW_ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)
RAW_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(RAW_ORDERS).parquet(f"{sf_dir}/orders.parquet")


def orders_from_raw(raw: DataFrame) -> DataFrame:
    """Amounts are rounded before the cast: few prices times 100 are whole doubles."""
    return raw.selectExpr(
        "o_orderkey + 1 AS id",
        "o_custkey AS seller_id",
        "CAST(round(o_totalprice * 100) AS BIGINT) AS amount",
        f"CASE WHEN o_orderstatus = 'F' THEN '{SETTLED}' ELSE '{CONFIRMED}' END AS status",
        "CAST(o_orderdate AS DATE) AS order_date",
        "o_orderdate AS created_at",
    )


def orders(
    spark: SparkSession, sf_dir: str, after: int | None = None, upto: int | None = None
) -> DataFrame:
    """Orders with ids above ``after`` and at most ``upto``."""
    raw = raw_orders(spark, sf_dir)
    if after is not None:
        raw = raw.filter(F.col("o_orderkey") > after - 1)
    if upto is not None:
        raw = raw.filter(F.col("o_orderkey") <= upto - 1)
    return orders_from_raw(raw)


def confirmed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_orders(spark, sf_dir).filter(~F.col("o_orderstatus").eqNullSafe("F"))
    return confirmed_scan(orders_from_raw(raw))


def settled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements, yet without ids, of the orders that are already settled."""
    raw = raw_orders(spark, sf_dir).filter(F.col("o_orderstatus") == "F")
    return stamp(settlement_projection(orders_from_raw(raw)), SETTLED_BEFORE)


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settlements table as earlier runs left it: unique ids, with gaps."""
    facts = settled_facts(spark, sf_dir)
    return facts.withColumn("id", F.col("order_id")).select(SETTLEMENTS.names)


def settlement_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unchecked settlement per order line, so most orders come up several times."""
    lines = spark.read.schema("l_orderkey long").parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select((F.col("l_orderkey") + 1).alias("order_id"))


def tagged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from a source that packs the priority into the status."""
    status = f"CASE WHEN o_orderstatus = 'F' THEN '{SETTLED}' ELSE '{CONFIRMED}' END"
    return raw_orders(spark, sf_dir).selectExpr(
        "o_orderkey + 1 AS id", f"{status} || ' ' || o_orderpriority AS status"
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(RAW_EVENTS).parquet(f"{sf_dir}/events.parquet")


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchecked incoming orders, one per event, two versions of each id in turn.

    User 0 stands for an unknown seller, and failed events bring no status. As with the
    given orders, an order counts as created at the start of its day.
    """
    return events(spark, sf_dir).selectExpr(
        "event_id div 2 * 4 + 1 AS id",
        "nullif(user_id, 0) AS seller_id",
        "CAST(round(value * 100) AS BIGINT) AS amount",
        f"CASE WHEN event_type <> 'error' THEN '{CONFIRMED}' END AS status",
        "CAST(ts AS DATE) AS order_date",
        "CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ) AS created_at",
        "event_id AS version",
    )


def feed_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the unchecked feed would settle to, with the version as settlement id."""
    facts = stamp(settlement_projection(order_feed(spark, sf_dir), "version"), SETTLED_AT)
    return facts.withColumnRenamed("version", "id").select(SETTLEMENTS.names)


def step_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log of the eight cases: each one's worker steps and the master summing them."""
    cases = F.array(*[F.lit(case) for _, *pair in CASE_PAIRS for case in pair])
    user = F.col("user_id")
    skipped = F.col("value") < 1
    workers = (
        events(spark, sf_dir)
        .groupBy(
            F.element_at(cases, (user % 8 + 1).cast("int")).alias("case_name"),
            (F.call_function("div", user, F.lit(8)) % GRID_SIZE).alias("worker"),
        )
        .agg(
            F.count(F.lit(1)).alias("read_count"),
            F.count_if(~skipped).alias("write_count"),
            F.count_if(skipped).alias("skip_count"),
            F.expr("sum(CAST(round(value * 100) AS BIGINT))").alias("duration_ms"),
        )
    )
    # one scan feeds both levels: the grouping id tells workers from their master
    counters = [F.sum(f.name).alias(f.name) for f in STEP_EXECUTIONS.fields[2:]]
    is_master = F.col("level") == 1
    worker_name = F.concat(F.lit("workerStep:partition"), F.col("worker").cast("string"))
    return (
        workers.groupingSets(
            [["case_name", "worker"], ["case_name"]], "case_name", "worker"
        )
        .agg(F.grouping("worker").alias("level"), *counters)
        .withColumn("step_name", F.when(is_master, F.lit("masterStep")).otherwise(worker_name))
        .select(STEP_EXECUTIONS.names)
    )


def job_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job row for each worker of the eight cases, failed if its errors are odd in number."""
    cases = F.array(*[F.lit(case) for _, *pair in CASE_PAIRS for case in pair])
    user = F.col("user_id")
    worker = (F.call_function("div", user, F.lit(8)) % GRID_SIZE).alias("worker")
    odd = F.count_if(F.col("event_type") == "error") % 2 == 1
    return (
        events(spark, sf_dir)
        .groupBy(F.element_at(cases, (user % 8 + 1).cast("int")).alias("case_name"), worker)
        .agg(F.when(odd, FAILED).otherwise(COMPLETED).alias("status"))
        .select(JOB_EXECUTIONS.names)
    )


def chunk_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(
        "event_type AS step", "event_id + 1 AS chunk_no", "value AS elapsed_ms"
    )
