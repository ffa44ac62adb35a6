"""Declared schemas and the fixed values of the data model."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

# Status literals, fee rule, chunking and generator ranges.
CONFIRMED = "CONFIRMED"
SETTLED = "SETTLED"
STATUS_LENGTH = 20
FEE_PERCENT = 3
CHUNK_SIZE = 1_000
GRID_SIZE = 4
INSERT_COUNT = 100_000
SELLER_COUNT = 500
MIN_AMOUNT = 1_000
MAX_AMOUNT = 100_000
ORDER_DATE = dt.date(2026, 3, 25)

ORDERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("seller_id", T.LongType(), False),
        T.StructField("amount", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("order_date", T.DateType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
    ]
)

# What one settlement says about its order; the surrogate id comes on top.
SETTLEMENT_FACTS = T.StructType(
    [
        T.StructField("order_id", T.LongType(), False),
        T.StructField("seller_id", T.LongType(), False),
        T.StructField("amount", T.LongType(), False),
        T.StructField("fee", T.LongType(), False),
        T.StructField("net_amount", T.LongType(), False),
        T.StructField("settled_at", T.TimestampNTZType(), False),
    ]
)

SETTLEMENTS = T.StructType([T.StructField("id", T.LongType(), False), *SETTLEMENT_FACTS.fields])

STEP_EXECUTIONS = T.StructType(
    [
        T.StructField("case_name", T.StringType(), False),
        T.StructField("step_name", T.StringType(), False),
        T.StructField("read_count", T.LongType(), False),
        T.StructField("write_count", T.LongType(), False),
        T.StructField("skip_count", T.LongType(), False),
        T.StructField("duration_ms", T.LongType(), False),
    ]
)

# What became of a run of a case.
COMPLETED, FAILED = "COMPLETED", "FAILED"
JOB_EXECUTIONS = T.StructType(
    [
        T.StructField("case_name", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
    ]
)

CHUNK_TIMINGS = T.StructType(
    [
        T.StructField("step", T.StringType(), False),
        T.StructField("chunk_no", T.LongType(), False),
        T.StructField("elapsed_ms", T.DoubleType(), False),
    ]
)
