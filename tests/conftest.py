import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyspark.schema import CONFIRMED, ORDER_DATE, ORDERS  # noqa: E402
from tallyspark.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_orders(spark):
    """Orders from (id, amount[, status]) tuples."""
    created = dt.datetime(2026, 3, 1, 12)

    def make(*rows):
        full = [(i, i + 100, a, (s or [CONFIRMED])[0], ORDER_DATE, created) for i, a, *s in rows]
        return spark.createDataFrame(full, ORDERS)

    return make
