"""Every query against DuckDB on the given tables, at every scale factor."""

import duckdb
import pytest

from conftest import TESTDATA
from tallyspark.oracles import ORACLES
from tallyspark.queries import QUERIES

TABLES = "orders lineitem events".split()

# DuckDB type -> Spark type
TYPES = {
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean",
}


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01", "sf0.1"])
def folder(request):
    return f"{TESTDATA}/{request.param}"


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def compare(spark, duck, folder, name):
    got = QUERIES[name](spark, folder)
    want = duck.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types)))
    assert {f.name: f.dataType.simpleString() for f in got.schema} == {
        c: TYPES[t] for c, t in types.items()
    }
    result = got.toArrow()  # DuckDB finds it by this name
    columns = ", ".join(names)
    ours, theirs = f"SELECT {columns} FROM result", f"SELECT {columns} FROM ({ORACLES[name]})"
    for left, right in ((ours, theirs), (theirs, ours)):
        assert duck.sql(f"({left}) EXCEPT ALL ({right}) LIMIT 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, duck, folder, name):
    compare(spark, duck, folder, name)


LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.mark.parametrize(
    "name",
    "unsettled_orders insert_settlements settle_orders upsert_orders chunk_numbers offset_page"
    " keyset_page bounded_keyset_page incremental_settle".split(),
)
def test_matches_duckdb_with_the_joins_of_large_tables(spark, duck, folder, name):
    before = {key: spark.conf.get(key, None) for key in LARGE}
    for key, value in LARGE.items():
        spark.conf.set(key, value)
    try:
        compare(spark, duck, folder, name)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
