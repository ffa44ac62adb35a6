"""Fee and net amount in exact integer minor units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.schema import FEE_PERCENT


def fee(amount: Column) -> Column:
    """Integer percentage truncated toward zero; overflow raises under ANSI mode."""
    return F.call_function("div", amount * F.lit(FEE_PERCENT), F.lit(100))


def net_amount(amount: Column) -> Column:
    return amount - fee(amount)
