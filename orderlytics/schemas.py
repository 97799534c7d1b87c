"""Logical tables: column types, value domains and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
# An order total is a sum over items, which may outgrow a single amount. Files
# that store it as MONEY are read as they are.
TOTAL = T.DecimalType(22, 2)

_AUDIT = [
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
    ("created_by", T.StringType()),
    ("updated_by", T.StringType()),
]


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


SCHEMAS: dict[str, T.StructType] = {
    "categories": _table(
        ("id", T.LongType()),
        ("uuid", T.StringType()),
        ("name", T.StringType()),
        ("parent_id", T.LongType()),
        ("path", T.StringType()),
        ("level", T.IntegerType()),
        ("is_active", T.BooleanType()),
        *_AUDIT,
    ),
    "nomenclature": _table(
        ("id", T.LongType()),
        ("uuid", T.StringType()),
        ("name", T.StringType()),
        ("description", T.StringType()),
        ("sku", T.StringType()),
        ("quantity", T.IntegerType()),
        ("price", MONEY),
        ("cost", MONEY),
        ("category_id", T.LongType()),
        ("is_active", T.BooleanType()),
        *_AUDIT,
    ),
    "clients": _table(
        ("id", T.LongType()),
        ("uuid", T.StringType()),
        ("name", T.StringType()),
        ("email", T.StringType()),
        ("phone", T.StringType()),
        ("address", T.StringType()),
        ("is_active", T.BooleanType()),
        *_AUDIT,
    ),
    "orders": _table(
        ("id", T.LongType()),
        ("uuid", T.StringType()),
        ("client_id", T.LongType()),
        ("order_number", T.StringType()),
        ("order_date", T.TimestampType()),
        ("total_amount", TOTAL),
        ("status", T.StringType()),
        ("payment_status", T.StringType()),
        ("notes", T.StringType()),
        *_AUDIT,
    ),
    "order_items": _table(
        ("id", T.LongType()),
        ("uuid", T.StringType()),
        ("order_id", T.LongType()),
        ("nomenclature_id", T.LongType()),
        ("quantity", T.IntegerType()),
        ("price", MONEY),
        ("total_price", MONEY),
        ("created_at", T.TimestampType()),
        ("created_by", T.StringType()),
    ),
}

# The closed domains of the two status columns.
ORDER_STATUSES = ("pending", "processing", "completed", "cancelled", "refunded")
PAYMENT_STATUSES = ("unpaid", "paid", "partial", "refunded")

# Orders in these states may not be deleted.
LOCKED_STATUSES = ("completed", "processing")

# Column defaults on insert, besides uuid and the time stamps.
DEFAULTS: dict[str, dict[str, object]] = {
    "categories": {"level": 0, "is_active": True},
    "nomenclature": {"quantity": 0, "is_active": True},
    "clients": {"is_active": True},
    "orders": {"total_amount": 0, "status": "pending", "payment_status": "unpaid"},
    "order_items": {},
}
