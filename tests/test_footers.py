"""Bounds and counts from the footers of stored orders."""

from tallyspark.sources import footers
from tallyspark.sources.fixtures import SETTLED_AT
from tallyspark.sources.generate import generate_orders


def test_bounds_of_each_status(spark, make_orders, tmp_path):
    orders = make_orders((7, 1), (-3, 1), (90, 1), (4, 1, "SETTLED"), (5, 1, "SETTLED"))
    footers.write_by_status(orders, f"{tmp_path}/orders")
    rows = {r["status"]: tuple(r)[1:] for r in footers.status_bounds(spark, f"{tmp_path}/orders").collect()}
    assert rows == {"CONFIRMED": (-3, 90, 3), "SETTLED": (4, 5, 2)}


def test_no_column_is_read(spark, tmp_path):
    folder = f"{tmp_path}/orders"
    footers.write_by_status(generate_orders(spark, 50_000, SETTLED_AT), folder)
    with footers.footer_reads(spark):
        bounds = footers._by_status(spark, folder)
        assert [tuple(r) for r in bounds.collect()] == [("CONFIRMED", 1, 50_000, 50_000)]
        text = bounds._jdf.queryExecution().toString()
    assert "PushedAggregation: [MIN(id), MAX(id), COUNT(*)]" in text
    assert "PushedGroupBy: [status]" in text
    assert "ReadSchema: struct<status:string,min(id):bigint,max(id):bigint,count(*):bigint>" in text


def test_settings_are_put_back(spark, tmp_path):
    before = [spark.conf.get(key, None) for key in footers.SETTINGS]
    footers.write_by_status(generate_orders(spark, 10, SETTLED_AT), f"{tmp_path}/orders")
    footers.status_bounds(spark, f"{tmp_path}/orders")
    assert [spark.conf.get(key, None) for key in footers.SETTINGS] == before
