"""Scan and versioned write of the logical tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.schemas import DEFAULTS, SCHEMAS


@dataclass(frozen=True)
class Tables:
    """The five logical tables; `item_key` orders the items of one order.

    `unique` may hold, per table, its unique column and id laid out for lookups by that column.
    A table that `with_` replaces loses its entry.
    """

    categories: DataFrame
    nomenclature: DataFrame
    clients: DataFrame
    orders: DataFrame
    order_items: DataFrame
    item_key: tuple[str, ...] = ("id",)
    unique: Mapping[str, DataFrame] = field(default_factory=dict)

    def with_(self, **changes: DataFrame) -> Tables:
        current = {name: index for name, index in self.unique.items() if name not in changes}
        return replace(self, **{"unique": current, **changes})


def load(spark: SparkSession, folder: str) -> Tables:
    """Tables stored as `<folder>/<table>`; the schema is declared, not inferred."""
    return Tables(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()})


def write(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Write a table version.

    Replacing a table means writing a new path: the input of a job is never
    overwritten by its own output. `append` adds files to an existing version.
    """
    if mode not in ("errorifexists", "append"):
        raise ValueError("a version is created or appended to, never overwritten")
    if partition_by:
        # One value may hold most rows, so rows are spread by the sizes Spark
        # measures: rebalancing splits large values and merges small ones.
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_orders_by_month(orders: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Orders laid out by calendar month so that date ranges prune folders."""
    month = F.date_format("order_date", "yyyy-MM")
    write(orders.withColumn("order_month", month), path, mode, ["order_month"])


def with_defaults(df: DataFrame, table: str, now: F.Column | None = None, actor: str = "api_user") -> DataFrame:
    """Fill what an insert leaves out: uuid, defaults, time stamps and author."""
    now = F.current_timestamp() if now is None else now
    fallback = {"uuid": F.expr("uuid()"), "created_at": now, "updated_at": now, "created_by": F.lit(actor)}
    fallback |= {name: F.lit(value) for name, value in DEFAULTS[table].items()}
    columns = []
    for field in SCHEMAS[table].fields:
        given = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = given.cast(field.dataType)
        if field.name in fallback:
            value = F.coalesce(value, fallback[field.name].cast(field.dataType))
        columns.append(value.alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in SCHEMAS[table].names]
    return df.select(*columns, *extra)
