"""Orders from and settlements to a relational database.

Reads and inserts go through Spark's JDBC source, whose driver jar is the cluster's
business. It knows no updates, so those go through a Python database connection per
partition. Nothing here connects before it is called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession

from tallyspark.operators.scans import typed_orders
from tallyspark.schema import CHUNK_SIZE, CONFIRMED, SETTLED

# Fixed value: connections the database is willing to serve at once.
POOL_SIZE = 10


def id_range_predicates(
    min_id: int, max_id: int, partitions: int, column: str = "id"
) -> list[str]:
    """One closed id range per partition.

    Spark's own lowerBound/upperBound only set the stride and leave the outer partitions
    open, so they would also read ids outside the bounds.
    """
    if max_id < min_id:
        return []
    width = (max_id - min_id) // partitions + 1
    starts = range(min_id, max_id + 1, width)
    return [f"{column} >= {s} AND {column} <= {min(s + width - 1, max_id)}" for s in starts]


def confirmed_bounds_query(table: str = "orders") -> str:
    """Table expression that has the database compute both bounds in one statement."""
    bounds = "SELECT MIN(id) AS min_id, MAX(id) AS max_id"
    return f"({bounds} FROM {table} WHERE status = '{CONFIRMED}') bounds"


def read_settings(batch: int = CHUNK_SIZE) -> dict[str, str]:
    """Rows come in batches instead of a whole result set, and local timestamps stay local."""
    return {"fetchsize": str(batch), "preferTimestampNTZ": "true"}


def read_orders(
    spark: SparkSession,
    url: str,
    min_id: int,
    max_id: int,
    table: str = "orders",
    partitions: int = POOL_SIZE,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Orders min_id..max_id, every partition over its own connection.

    Id order within a connection is the database's to give; Spark reads them in parallel.
    """
    settings = {**read_settings(), **(properties or {})}
    ranges = id_range_predicates(min_id, max_id, partitions) or ["1 = 0"]
    return typed_orders(spark.read.jdbc(url, table, predicates=ranges, properties=settings))


def write_settings(connections: int = POOL_SIZE, batch: int = CHUNK_SIZE) -> dict[str, str]:
    """``numPartitions`` caps the connections; ``statement_order`` has dealt out as many."""
    return {"batchsize": str(batch), "numPartitions": str(connections)}


def statement_order(rows: DataFrame, key: str, connections: int = POOL_SIZE) -> DataFrame:
    """A range of keys for each connection, in key order, so that a batch touches neighbouring
    rows. The exchange keeps what comes before it on all executors."""
    return rows.repartitionByRange(connections, key).sortWithinPartitions(key)


def append_rows(
    rows: DataFrame,
    url: str,
    table: str,
    key: str,
    connections: int = POOL_SIZE,
    batch: int = CHUNK_SIZE,
    properties: dict[str, str] | None = None,
) -> None:
    """Batched inserts in key order within each connection.

    Each partition commits once. Should a task run again after its commit, the table's
    unique key refuses the second copy; run the settled-before check against the table
    and append again to go on.
    """
    settings = {**write_settings(connections, batch), **(properties or {})}
    statement_order(rows, key, connections).write.jdbc(url, table, mode="append", properties=settings)


def update_status(
    keys: DataFrame,
    connect: Callable[[], object],
    key: str = "order_id",
    table: str = "orders",
    connections: int = POOL_SIZE,
    batch: int = CHUNK_SIZE,
    placeholder: str = "?",
) -> None:
    """Marks the orders in ``keys`` settled, ``batch`` at a time with a commit each.

    ``connect`` opens a DB-API connection and runs in the tasks. An update that a retried
    task repeats changes nothing, so lost executors are harmless.
    """
    statement = f"UPDATE {table} SET status = {placeholder} WHERE id = {placeholder}"
    settled = SETTLED

    def update(rows: Iterator[Row]) -> None:
        connection = connect()
        try:
            cursor = connection.cursor()
            while chunk := [(settled, row[0]) for row in islice(rows, batch)]:
                cursor.executemany(statement, chunk)
                connection.commit()
        finally:
            connection.close()

    statement_order(keys.select(key), key, connections).foreachPartition(update)
