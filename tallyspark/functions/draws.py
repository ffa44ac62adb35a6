"""Deterministic uniform draws: a hash of the row key, so a lost task redraws the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int, low: int, high: int) -> Column:
    """Uniform integer in low..high, both inclusive."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(high - low + 1).cast("long")) + F.lit(low)
