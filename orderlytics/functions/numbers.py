"""Order numbers and their numeric part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_number(number: Column) -> Column:
    """`ORD-` and at least six digits; longer numbers are not cut."""
    digits = number.cast("string")
    return F.concat(F.lit("ORD-"), F.when(number < 1_000_000, F.lpad(digits, 6, "0")).otherwise(digits))


def number_value(number: Column) -> Column:
    """Numeric part of `ORD-<digits>`; NULL for any other form."""
    return F.nullif(F.regexp_extract(number, "^ORD-([0-9]+)$", 1), F.lit("")).try_cast("bigint")
