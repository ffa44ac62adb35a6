"""Every operator applied to the given tables: query name -> (session, folder) -> rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyspark.operators import (
    constraints,
    mutations,
    numbering,
    pages,
    ranges,
    runlog,
    scans,
    settle,
)
from tallyspark.plans import audited, ledger, page_index, ranged
from tallyspark.schema import (
    CONFIRMED,
    MAX_AMOUNT,
    MIN_AMOUNT,
    ORDER_DATE,
    ORDERS,
    SELLER_COUNT,
    SETTLED,
    SETTLEMENT_FACTS,
    SETTLEMENTS,
)
from tallyspark.session import scratch_folder
from tallyspark.sources import fixtures, footers, generate, tables
from tallyspark.sources.fixtures import SETTLED_AT
from tallyspark.streaming import incremental, keyed
from tallyspark.streaming import runlog as stream_log

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values of the paged reads; pages have the default size of 1000 rows.
CURSOR = 5_000
CURSOR_LIMIT = 5_500
PAGE = 5
# The highest id of the bounded reads, within the smaller tables.
BOUND = 5_000
# Ids of a first append, and widths of index buckets and ranges that give small tables several.
INDEXED_FIRST = 8_000
INDEX_BITS = 10
RANGED_BITS = 12
# Parts that the orders of a feed arrive in, each with those of the parts before.
FEED_PARTS = 4
# Orders and their lines, roughly, that one task joins.
FEED_ROWS = 1 << 19
# Those whose arrivals one task of the stream compares with its state; each has a state store.
STATE_ROWS = 1 << 21


def _reset(spark: SparkSession, sf_dir: str, after: int | None = 0) -> DataFrame:
    return mutations.reset_orders(fixtures.orders(spark, sf_dir, after=after))


def orders_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.typed_orders(fixtures.orders(spark, sf_dir))


def confirmed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.confirmed_orders(spark, sf_dir)


def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.offset_page(fixtures.confirmed_orders(spark, sf_dir), PAGE)


def indexed_offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of ``offset_page`` through an index that has grown with an append."""
    root = f"{scratch_folder(spark, 'indexed')}/orders"
    small = F.col("id") <= INDEXED_FIRST
    orders = fixtures.orders(spark, sf_dir)
    for part in (orders.filter(small), orders.filter(~small)):
        tables.append_rows(tables.cluster_by_id(part), root)
        page_index.refresh(spark, root, "confirmed", page_index.confirmed(), bits=INDEX_BITS)
    return page_index.indexed_page(spark, root, "confirmed", page_index.confirmed(), PAGE)


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.keyset_page(fixtures.orders(spark, sf_dir, after=CURSOR), CURSOR)


def bounded_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fixtures.orders(spark, sf_dir, after=CURSOR, upto=CURSOR_LIMIT)
    return pages.keyset_page(orders, CURSOR, upto=CURSOR_LIMIT)


def full_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.full_read(fixtures.orders(spark, sf_dir, after=0))


def id_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fixtures.orders(spark, sf_dir, after=0, upto=BOUND)
    return scans.id_range_scan(orders, 1, BOUND)


def settlement_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.settlement_projection(fixtures.orders(spark, sf_dir))


def settle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.settle_status(_reset(spark, sf_dir))


def settle_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.settle_full(_reset(spark, sf_dir), SETTLED_AT)


def settle_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fixtures.orders(spark, sf_dir, after=0, upto=BOUND)
    return settle.settle_bounded(mutations.reset_orders(orders), SETTLED_AT)


def settle_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.settle_ranged(_reset(spark, sf_dir, after=None), SETTLED_AT)


def settle_by_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements, with their ids, of ranges that commit one by one."""
    folder = scratch_folder(spark, "ledger")
    tables.write_version(_reset(spark, sf_dir, after=None), f"{folder}/orders")
    ledger.settle_by_ranges(spark, folder, SETTLED_AT)
    return tables.read_table(spark, f"{folder}/settlements", SETTLEMENTS)


def unsettled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.unsettled_orders(
        fixtures.orders(spark, sf_dir), fixtures.settled_facts(spark, sf_dir)
    )


def insert_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier = fixtures.settlements(spark, sf_dir)
    return settle.insert_settlements(fixtures.orders(spark, sf_dir), earlier, SETTLED_AT)


def _tried_appends(spark: SparkSession, sf_dir: str) -> tuple[str, list[audited.Audit]]:
    """Four appends: earlier settlements, an unchecked feed, new ones, the earlier ones again."""
    folder = scratch_folder(spark, "audited")
    earlier = fixtures.settlements(spark, sf_dir)
    confirmed = fixtures.confirmed_orders(spark, sf_dir)
    audits = []

    def attempt(rows: DataFrame) -> None:
        visible = tables.read_batches(spark, folder, SETTLEMENTS)
        audits.append(audited.tried_append(rows, folder, len(audits), visible))

    attempt(earlier)
    attempt(fixtures.feed_settlements(spark, sf_dir))
    highest = F.lit(tables.highest_id(spark, folder))
    attempt(settle.numbered_settlements(confirmed, SETTLED_AT, highest))
    attempt(earlier)
    return folder, audits


def audited_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is visible after appends of which some break a constraint."""
    folder, _ = _tried_appends(spark, sf_dir)
    return tables.read_batches(spark, folder, SETTLEMENTS)


def append_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit of each of these appends found."""
    return audited.audit_rows(spark, _tried_appends(spark, sf_dir)[1])


def settle_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reset orders after the settlements of an earlier run are applied to them."""
    return mutations.settle_orders(
        _reset(spark, sf_dir, after=None), fixtures.settled_facts(spark, sf_dir)
    )


def settle_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``settle_orders`` of stored orders by ranges, of which the lower half is touched."""
    root = scratch_folder(spark, "ranged")
    ranged.write_ranged(_reset(spark, sf_dir, after=None), root, RANGED_BITS)
    half = fixtures.settled_facts(spark, sf_dir).filter(F.col("order_id") <= BOUND)
    ranged.settle_in_place(spark, root, half, bits=RANGED_BITS)
    return ranged.read_ranged(spark, root)


def upsert_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``upsert_orders`` of stored orders by ranges."""
    root = scratch_folder(spark, "ranged")
    ranged.write_ranged(fixtures.orders(spark, sf_dir), root, RANGED_BITS)
    complete, _ = constraints.without_nulls(fixtures.order_feed(spark, sf_dir), ORDERS.names)
    incoming = complete.withColumn("status", F.lit(SETTLED))
    ranged.upsert_in_place(spark, root, incoming, "version", RANGED_BITS)
    return ranged.read_ranged(spark, root)


def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's complete rows merged; the others are those of ``rejected_orders``."""
    complete, _ = constraints.without_nulls(fixtures.order_feed(spark, sf_dir), ORDERS.names)
    incoming = complete.withColumn("status", F.lit(SETTLED))
    return mutations.upsert_orders(fixtures.orders(spark, sf_dir), incoming, "version")


def rejected_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows that ``upsert_orders`` does not merge, as they lack a value."""
    return constraints.without_nulls(fixtures.order_feed(spark, sf_dir), ORDERS.names)[1]


def reset_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reset(spark, sf_dir, after=None)


def confirmed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.confirmed_bounds(fixtures.confirmed_orders(spark, sf_dir))


def footer_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and number of the orders of each status, from the footers of stored orders."""
    folder = scratch_folder(spark, "by-status")
    footers.write_by_status(fixtures.orders(spark, sf_dir), folder)
    return footers.status_bounds(spark, folder)


def order_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.order_count(fixtures.orders(spark, sf_dir))


def range_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.range_partitions(fixtures.confirmed_orders(spark, sf_dir))


def partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.partition_stats(fixtures.orders(spark, sf_dir))


def chunk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fixtures.confirmed_orders(spark, sf_dir).select("id")
    return numbering.chunk_numbers(ids)


def duplicate_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.duplicate_settlements(fixtures.settlement_attempts(spark, sf_dir))


def null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = fixtures.order_feed(spark, sf_dir)
    return constraints.null_violations(feed, ORDERS.names)


def settlement_null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.feed_settlements(spark, sf_dir)
    return constraints.null_violations(rows, SETTLEMENTS.names)


def status_length_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.status_length_violations(fixtures.tagged_orders(spark, sf_dir))


def _generator_invariants(made: DataFrame) -> DataFrame:
    def within(name: str, low: int, high: int):
        return F.count_if(F.col(name).between(low, high))

    return made.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("id").alias("min_id"),
        F.max("id").alias("max_id"),
        within("seller_id", 1, SELLER_COUNT).alias("sellers_in_range"),
        within("amount", MIN_AMOUNT, MAX_AMOUNT).alias("amounts_in_range"),
        F.count_if(F.col("status") == CONFIRMED).alias("confirmed"),
        F.count_if(F.col("order_date") == F.lit(ORDER_DATE)).alias("on_order_date"),
    )


def generate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many synthetic orders as there are given ones."""
    count = generate.order_count(fixtures.orders(spark, sf_dir)).first()["order_count"]
    return _generator_invariants(generate.generate_orders(spark, count, SETTLED_AT))


def top_up_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given orders topped up to the number of order lines: (origin, rows, ids)."""
    orders = fixtures.orders(spark, sf_dir)
    target = fixtures.settlement_attempts(spark, sf_dir).count()
    topped = generate.top_up_orders(orders, target, SETTLED_AT)
    made = F.col("created_at") == F.lit(SETTLED_AT.isoformat(" ")).cast("timestamp_ntz")
    return topped.groupBy(made.alias("is_generated")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("id").alias("min_id"),
        F.max("id").alias("max_id"),
    )


def step_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.step_totals(fixtures.step_executions(spark, sf_dir))


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.throughput(fixtures.step_executions(spark, sf_dir))


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.run_report(fixtures.step_executions(spark, sf_dir))


def run_status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, jobs = fixtures.step_executions(spark, sf_dir), fixtures.job_executions(spark, sf_dir)
    return runlog.status_report(steps, jobs)


def case_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.case_speedup(fixtures.step_executions(spark, sf_dir))


def chunk_timing_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.chunk_timing_by_step(fixtures.chunk_timings(spark, sf_dir))


def chunk_first_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.chunk_first_latest(fixtures.chunk_timings(spark, sf_dir))


def chunk_timing_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.chunk_timing_samples(fixtures.chunk_timings(spark, sf_dir))


def incremental_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = incremental.table_stream(spark, f"{sf_dir}/orders.parquet", fixtures.RAW_ORDERS)
    orders = mutations.reset_orders(fixtures.orders_from_raw(raw))
    run = scratch_folder(spark, "incremental-settle")
    return incremental.settle_arrived(orders, f"{run}/settlements", f"{run}/progress", SETTLED_AT)


def _settled_feed(spark: SparkSession, sf_dir: str) -> tuple[str, list[StreamingQuery]]:
    """A fresh folder, and the runs of the stream in it, one for each part of the lines' orders
    that arrives there: most come repeatedly.

    A part is as many files as tasks have made it, and there are more tasks the more rows there
    are. The stream goes on as soon as a part has arrived, which thus is one micro-batch; its
    state, too, is dealt to the more tasks the more rows there are.
    """
    run = scratch_folder(spark, "keyed-settle")
    lines = fixtures.settlement_attempts(spark, sf_dir).withColumnRenamed("order_id", "id")
    orders = _reset(spark, sf_dir)
    rows = orders.count() + lines.count()
    tasks = max(1, -(-rows // FEED_ROWS))
    stores = max(1, -(-rows // STATE_ROWS))
    arriving = orders.repartition(tasks, "id").join(lines.repartition(tasks, "id"), "id").select(ORDERS.names)
    runs = []
    for part in range(FEED_PARTS):
        arriving.filter(F.col("id") % FEED_PARTS <= part).write.mode("append").parquet(f"{run}/in")
        arrived = incremental.orders_stream(spark, f"{run}/in", files_per_trigger=incremental.ALL_FILES)
        query = keyed.start_keyed(arrived, f"{run}/out", f"{run}/progress", SETTLED_AT, partitions=stores)
        runs.append(query)
        runs[-1].awaitTermination()
    return run, runs


def keyed_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of every line settled when it arrives first, from repeats over several batches."""
    run, _ = _settled_feed(spark, sf_dir)
    return keyed.keyed_settlements(spark, f"{run}/out").select(SETTLEMENT_FACTS.names)


def stream_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log of that stream, without its times, and its number of chunks."""
    log = stream_log.StreamLog()
    spark.streams.addListener(log)
    try:
        _, runs = _settled_feed(spark, sf_dir)
        steps = [stream_log.step_executions(spark, log, query, "incremental") for query in runs]
        chunks = [stream_log.chunk_timings(spark, log, query) for query in runs]
    finally:
        spark.streams.removeListener(log)
    timed = runlog.chunk_timing_by_step(reduce(DataFrame.unionByName, chunks))
    counted = timed.select("chunk_count").scalar()
    totals = runlog.step_totals(reduce(DataFrame.unionByName, steps))
    return totals.drop("duration_ms").withColumn("chunk_count", counted)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        settle_full,
        orders_scan,
        confirmed_scan,
        offset_page,
        indexed_offset_page,
        keyset_page,
        bounded_keyset_page,
        full_read,
        id_range_scan,
        settlement_projection,
        settle_status,
        settle_bounded,
        settle_ranged,
        settle_by_ledger,
        unsettled_orders,
        insert_settlements,
        audited_settlements,
        append_audits,
        settle_orders,
        settle_in_place,
        upsert_orders,
        upsert_in_place,
        rejected_orders,
        reset_orders,
        confirmed_bounds,
        footer_bounds,
        order_count,
        range_partitions,
        partition_stats,
        chunk_numbers,
        duplicate_settlements,
        null_violations,
        settlement_null_violations,
        status_length_violations,
        generate_orders,
        top_up_orders,
        step_totals,
        throughput,
        run_report,
        run_status_report,
        case_speedup,
        chunk_timing_by_step,
        chunk_first_latest,
        chunk_timing_samples,
        incremental_settle,
        keyed_settle,
        stream_run_report,
    )
}
