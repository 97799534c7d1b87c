"""Money, averages and zero filling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(amount: Column) -> Column:
    """Exact decimal inside, double at the edge of a report."""
    return amount.cast("double")


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("double"))


def count_or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("bigint"))


def mean(total: Column, count: Column) -> Column:
    """Average from a sum and a count; NULL for an empty group."""
    return F.try_divide(as_double(total), as_double(count))


def ratio(part: Column, whole: Column) -> Column:
    """Quotient rounded half up to two digits, 0 when there is no whole."""
    scaled = F.floor(as_double(part) * 100 / as_double(whole) + 0.5) / 100
    return F.when(whole > 0, scaled.cast("double")).otherwise(F.lit(0.0))
