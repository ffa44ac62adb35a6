"""Arithmetic on 64-bit ids: power-of-two buckets and equal-width ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(key: Column, bits: int) -> Column:
    """Number of the 2**bits wide bucket; floors, also for negative ids."""
    return F.shiftright(key, bits)


def bucket_start(number: Column, bits: int) -> Column:
    return F.shiftleft(number, bits)


def bucket_end(number: Column, bits: int) -> Column:
    """Last id of a bucket. Bit arithmetic, so it cannot overflow."""
    return F.shiftleft(number, bits).bitwiseOR(F.lit((1 << bits) - 1))


def range_width(min_id: Column, max_id: Column, grid: int) -> Column:
    return F.call_function("div", max_id - min_id, F.lit(grid)) + F.lit(1)


def range_number(key: Column, min_id: Column, width: Column) -> Column:
    """Range of an id at or above ``min_id``."""
    return F.call_function("div", key - min_id, width)


def range_label(number: Column) -> Column:
    return F.concat(F.lit("partition"), number.cast("string"))
