"""Filter building blocks."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from orderlytics.schemas import ORDER_STATUSES, PAYMENT_STATUSES


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def contains_text(query: str, *columns: str) -> Column:
    """Case-insensitive substring in any column; `%` and `_` stay wildcards."""
    return reduce(or_, (F.ilike(F.col(c), F.lit(f"%{query}%")) for c in columns))


def not_cancelled(status: str = "status") -> Column:
    """A NULL status is neither cancelled nor live, so it is filtered out."""
    return F.col(status) != "cancelled"


def require_status(value: str) -> str:
    if value not in ORDER_STATUSES:
        raise ValueError(f"unknown order status {value!r}")
    return value


def require_payment_status(value: str) -> str:
    if value not in PAYMENT_STATUSES:
        raise ValueError(f"unknown payment status {value!r}")
    return value


def moment(value: datetime, kind: DataType) -> Column:
    """A date bound of the column's own type, so that the filter reaches the files.

    A bound without time zone is read as UTC.
    """
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast(kind)


def amount(value: Decimal | float) -> Column:
    """A money bound as an exact decimal; a double would turn the column into one."""
    return F.lit(Decimal(str(value)))
