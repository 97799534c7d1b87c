"""Whole orders: batches of new ones, and deletion with everything that hangs on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.functions.numbers import number_value
from orderlytics.operators.changes import (
    ACTOR,
    apply_stock,
    assign_order_numbers,
    cascade_delete,
    guarded_delete,
    order_stock_deltas,
    order_totals,
)
from orderlytics.operators.intake import order_intake
from orderlytics.operators.integrity import VIOLATIONS, accepted, record_rules, rejected
from orderlytics.session import cut_lineage
from orderlytics.sources.tables import Tables, with_defaults


@dataclass(frozen=True)
class OrdersChanged:
    """The tables after the batch, and the orders that were refused, with a reason.

    `gone` (ids of deleted orders) and `restocked` (whole new rows of products) are what a deletion changes.
    """

    orders: DataFrame
    order_items: DataFrame
    nomenclature: DataFrame
    rejected: DataFrame
    gone: DataFrame | None = None
    restocked: DataFrame | None = None


def create_orders(
    t: Tables, orders: DataFrame, items: DataFrame, arrival: Sequence[str], actor: str = ACTOR, now: Column | None = None
) -> OrdersChanged:
    """Take new orders with their items as if they arrived one by one.

    An order is left out with its items when it breaks a field rule or has no id
    (`invalid_fields`), when a stored order or an earlier one of the batch has its id (`id_taken`)
    or the number it brings (`number_taken`), when it brings a number of the shop's own series,
    which only the shop gives (`number_reserved`), or when the intake refuses it. An earlier order
    holds its id and number whether or not the intake takes it. The others get defaults, a number
    and the sum of their items, and their quantities leave the stock.
    """
    if "order_number" not in orders.columns:
        orders = orders.withColumn("order_number", F.lit(None).cast("string"))
    codes = F.when(F.col("id").isNull(), F.array(F.lit("id_missing"))).otherwise(F.col(VIOLATIONS))
    checked = record_rules(orders, "orders").withColumn(VIOLATIONS, codes)
    named = cut_lineage(_names_checked(accepted(checked), t.orders, arrival), "offered-orders")
    sound = named.where("reason IS NULL").drop("reason")
    decided = order_intake(sound, items, t.clients, t.nomenclature, arrival, t.item_key)
    decided = cut_lineage(decided, "decisions")
    taken = decided.where("accepted").select("id")
    product = decided.schema["nomenclature_id"].dataType
    broken = rejected(checked).select("id", F.lit("invalid_fields").alias("reason"))
    broken = broken.unionByName(named.where("reason IS NOT NULL").select("id", "reason"))
    broken = broken.withColumn("nomenclature_id", F.lit(None).cast(product))

    when = F.current_timestamp() if now is None else now
    numbered = assign_order_numbers(t.orders, sound.join(taken, "id", "left_semi"), [*arrival])
    if "order_date" in numbered.columns:
        numbered = numbered.withColumn("order_date", F.coalesce("order_date", when.cast(numbered.schema["order_date"].dataType)))
    lines = items.join(taken.withColumnRenamed("id", "order_id"), "order_id", "left_semi")
    lines = with_defaults(lines.withColumn("total_price", F.col("quantity") * F.col("price")), "order_items", now, actor)
    # Three tables come from these items, which are as large as the batch: they are put together once.
    lines = cut_lineage(lines, "created-items")
    new = order_totals(with_defaults(numbered, "orders", now, actor), lines, taken)
    stock = apply_stock(t.nomenclature, order_stock_deltas(lines, None, -1), actor, now).table

    return OrdersChanged(
        orders=t.orders.unionByName(new.select(t.orders.columns)),
        order_items=t.order_items.unionByName(lines.select(t.order_items.columns)),
        nomenclature=stock,
        rejected=decided.where("NOT accepted").drop("accepted").unionByName(broken),
    )


def _names_checked(orders: DataFrame, stored: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Add `reason`: why an order cannot have the id or the number it brings, else NULL.

    First holders are minima per value, so a value that most orders bring gathers nowhere;
    orders without a number, most of them, take no part in the comparison of numbers.
    """
    place = F.struct(*[F.col(c) for c in arrival])

    def held(rows: DataFrame, name: str) -> DataFrame:
        first = rows.groupBy(name).agg(F.min(place).alias("_first"))
        known = stored.select(name).distinct().withColumn("_stored", F.lit(True))
        joined = rows.join(first, name).join(known, name, "left")
        taken = F.col("_stored").isNotNull() | (place != F.col("_first"))
        return joined.withColumn("_taken", taken).select(*orders.columns, "_taken")

    ids = cut_lineage(held(orders, "id"), "order-ids")
    twice = ids.where("_taken").select(*orders.columns, F.lit("id_taken").alias("reason"))
    fresh = ids.where("NOT _taken").drop("_taken")
    numbered = F.coalesce(F.col("order_number"), F.lit("")) != ""
    own = number_value(F.col("order_number")).isNotNull()
    reason = F.when(F.col("_taken"), "number_taken").when(own, "number_reserved")
    given = held(fresh.where(numbered), "order_number").select(*orders.columns, reason.alias("reason"))
    none = fresh.where(~numbered).withColumn("reason", F.lit(None).cast("string"))
    return none.unionByName(given).unionByName(twice)


def delete_orders(t: Tables, order_ids: DataFrame, actor: str = ACTOR, now: Column | None = None) -> OrdersChanged:
    """Delete orders that are not locked, with their items, and give their quantities back to the stock."""
    refused = guarded_delete("orders", t, order_ids).rejected
    done = cascade_delete(t, order_ids.select("id").join(refused, "id", "left_anti"))
    stock = apply_stock(t.nomenclature, done.stock_deltas, actor, now)
    return OrdersChanged(done.orders, done.order_items, stock.table, refused, done.gone, stock.changed)
