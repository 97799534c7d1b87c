"""Aggregate reports over clients, orders, products and categories.

Items are summed per order before any join, so a report reads and shuffles the
items once, already combined on the map side, and an order is one row when it
is counted. No count needs DISTINCT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.functions.measures import as_double, count_or_zero, mean, or_zero, ratio
from orderlytics.functions.predicates import not_cancelled
from orderlytics.operators.running import POSITION, placed
from orderlytics.sources.tables import Tables

MAX_TOP = 50


def item_totals(order_items: DataFrame) -> DataFrame:
    """One row per order that has items: how many, and what they cost."""
    return order_items.groupBy(F.col("order_id").alias("id")).agg(
        F.count(F.lit(1)).alias("items"), F.sum("total_price").alias("amount")
    )


def live_orders(t: Tables, how: str) -> DataFrame:
    """Non-cancelled orders with their item totals; `how` keeps or drops empty ones."""
    return t.orders.where(not_cancelled()).join(item_totals(t.order_items), "id", how)


def client_totals(t: Tables, how: str = "left") -> DataFrame:
    """Item rows, amount, orders and last order per client, cancelled orders left out."""
    return (
        live_orders(t, how)
        .groupBy("client_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("items").alias("items"),
            F.sum("amount").alias("amount"),
            F.max("order_date").alias("last_order"),
        )
    )


def _clients_with_totals(t: Tables, only_active: bool, how_orders: str, how_clients: str) -> DataFrame:
    clients = t.clients.where("is_active") if only_active else t.clients
    names = clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    return names.join(client_totals(t, how_orders), "client_id", how_clients)


def _check_top(limit: int) -> int:
    if not 1 <= limit <= MAX_TOP:
        raise ValueError(f"limit must be between 1 and {MAX_TOP}")
    return limit


def client_order_summary(t: Tables) -> DataFrame:
    """Ordered amount, order count and last order of every active client."""
    return (
        _clients_with_totals(t, True, "left", "left")
        .select(
            "client_id",
            "client_name",
            or_zero(as_double(F.col("amount"))).alias("total_amount"),
            count_or_zero(F.col("orders")).alias("orders_count"),
            "last_order",
        )
        .orderBy(F.desc("total_amount"), "client_name", "client_id")
    )


def client_stats(t: Tables) -> DataFrame:
    """The client summary with the average amount of an item row."""
    return (
        _clients_with_totals(t, True, "left", "left")
        .select(
            "client_id",
            "client_name",
            or_zero(as_double(F.col("amount"))).alias("total_amount"),
            count_or_zero(F.col("orders")).alias("orders_count"),
            or_zero(mean(F.col("amount"), F.col("items"))).alias("avg_order"),
            "last_order",
        )
        .orderBy(F.desc("total_amount"), "client_id")
    )


def client_point_stats(t: Tables) -> DataFrame:
    """Order count and spend per client id, straight from the orders."""
    return client_totals(t).select(
        "client_id",
        F.col("orders").alias("orders_count"),
        or_zero(as_double(F.col("amount"))).alias("total_spent"),
    )


def top_clients(t: Tables, limit: int = 5, require_active: bool = True) -> DataFrame:
    """Clients with the highest ordered amount; ties go to the lower id."""
    return (
        _clients_with_totals(t, require_active, "inner", "inner")
        .select(
            "client_id",
            "client_name",
            as_double(F.col("amount")).alias("total_amount"),
            F.col("orders").alias("orders_count"),
            mean(F.col("amount"), F.col("items")).alias("avg_order"),
            "last_order",
        )
        .orderBy(F.desc("total_amount"), "client_id")
        .limit(_check_top(limit))
    )


def category_children_count(t: Tables) -> DataFrame:
    """Active roots with the number of their active direct children.

    A root's full path is its own name and its children are one equi-join away,
    so the report needs no walk of the tree.
    """
    active = t.categories.where("is_active")
    children = active.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return (
        active.where("parent_id IS NULL")
        .join(children, "id", "left")
        .select(
            F.col("id").alias("category_id"),
            F.col("name").alias("category_name"),
            count_or_zero(F.col("children")).alias("children_count"),
            "level",
            F.col("name").alias("full_path"),
        )
        .orderBy("category_name", "category_id")
    )


def category_stats(t: Tables, zero_fill: bool = True) -> DataFrame:
    """Active products, stock, prices and stock value of every active category."""
    value = F.col("price") * F.col("quantity")
    per_category = (
        t.nomenclature.where("is_active")
        .groupBy("category_id")
        .agg(
            F.count(F.lit(1)).alias("products"),
            F.sum("quantity").alias("stock"),
            F.sum("price").alias("price_sum"),
            F.min("price").alias("low"),
            F.max("price").alias("high"),
            F.sum(value).alias("value"),
        )
    )
    fill = or_zero if zero_fill else lambda c: c
    fill_count = count_or_zero if zero_fill else lambda c: c
    categories = t.categories.where("is_active").select(
        F.col("id").alias("category_id"), F.col("name").alias("category_name")
    )
    return (
        categories.join(per_category, "category_id", "left")
        .select(
            "category_id",
            "category_name",
            count_or_zero(F.col("products")).alias("products_count"),
            fill_count(F.col("stock")).alias("total_quantity"),
            fill(mean(F.col("price_sum"), F.col("products"))).alias("avg_price"),
            fill(as_double(F.col("low"))).alias("min_price"),
            fill(as_double(F.col("high"))).alias("max_price"),
            fill(as_double(F.col("value"))).alias("total_value"),
        )
        .orderBy(F.desc_nulls_last("total_value"), "category_id")
    )


def sales_by_month(t: Tables) -> DataFrame:
    """Orders, item rows, amount and average item amount per calendar month."""
    month = F.date_trunc("month", "order_date").cast("timestamp_ntz")
    return (
        live_orders(t, "inner")
        .groupBy(month.alias("month"))
        .agg(
            F.count(F.lit(1)).alias("orders_count"),
            F.sum("items").alias("items_count"),
            F.sum("amount").alias("amount"),
        )
        .select(
            "month",
            "orders_count",
            "items_count",
            as_double(F.col("amount")).alias("total_amount"),
            mean(F.col("amount"), F.col("items_count")).alias("avg_order"),
        )
        .orderBy(F.desc("month"))
    )


def _product_names(t: Tables, only_active: bool) -> DataFrame:
    """Products that have a category, with its name."""
    products = t.nomenclature.where("is_active") if only_active else t.nomenclature
    categories = t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return products.select(
        F.col("id").alias("nomenclature_id"), F.col("name").alias("product_name"), "sku", "category_id"
    ).join(categories, "category_id")


def _product_totals(items: DataFrame, order_counts: Column) -> DataFrame:
    """Units, revenue and orders per product.

    Items arrive partitioned by order, so the first aggregate costs no shuffle
    and leaves one row per order and product; the second then counts orders
    without DISTINCT.
    """
    per_order = items.groupBy("order_id", "nomenclature_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("quantity").alias("quantity"),
        F.sum("total_price").alias("amount"),
        F.sum("price").alias("price_sum"),
        F.max(order_counts.cast("int")).alias("counts"),
    )
    return per_order.groupBy("nomenclature_id").agg(
        F.sum("items").alias("items"),
        F.sum("quantity").alias("quantity"),
        F.sum("amount").alias("amount"),
        F.sum("price_sum").alias("price_sum"),
        F.sum("counts").alias("orders"),
    )


def top_products(t: Tables, limit: int = 10, require_active: bool = True) -> DataFrame:
    """Products with the highest non-cancelled revenue; ties go to the lower id."""
    live = t.orders.where(not_cancelled()).select(F.col("id").alias("order_id"))
    totals = _product_totals(t.order_items.join(live, "order_id"), F.lit(1))
    return (
        _product_names(t, require_active)
        .join(totals, "nomenclature_id")
        .select(
            "nomenclature_id",
            "product_name",
            "sku",
            "category_name",
            F.col("quantity").alias("total_sold"),
            as_double(F.col("amount")).alias("total_revenue"),
            F.col("orders").alias("orders_count"),
        )
        .orderBy(F.desc("total_revenue"), "nomenclature_id")
        .limit(_check_top(limit))
    )


def product_stats(t: Tables, exclude_cancelled_items: bool = False) -> DataFrame:
    """Units, revenue, orders and average sale price of every active product.

    Units and revenue include cancelled orders unless asked otherwise; the
    order count never does.
    """
    live = t.orders.where(not_cancelled()).select(F.col("id").alias("order_id"), F.lit(True).alias("live"))
    items = t.order_items.join(live, "order_id", "inner" if exclude_cancelled_items else "left")
    totals = _product_totals(items, F.coalesce(F.col("live"), F.lit(False)))
    return (
        _product_names(t, True)
        .join(totals, "nomenclature_id", "left")
        .select(
            "nomenclature_id",
            F.col("product_name").alias("name"),
            "sku",
            "category_name",
            count_or_zero(F.col("quantity")).alias("total_sold"),
            or_zero(as_double(F.col("amount"))).alias("total_revenue"),
            count_or_zero(F.col("orders")).alias("orders_count"),
            or_zero(mean(F.col("price_sum"), F.col("items"))).alias("avg_price"),
        )
        .orderBy(F.desc("total_revenue"), "nomenclature_id")
    )


def category_effectiveness(
    t: Tables, exclude_cancelled_items: bool = False, distinct_products: bool = False
) -> DataFrame:
    """Products, item rows, sales and their ratio per active category.

    As defined by the report, a product is counted once per item row it was
    sold in (an unsold product once), and items of cancelled orders count.
    Both flags turn to the stricter reading.
    """
    items = t.order_items
    if exclude_cancelled_items:
        live = t.orders.where(not_cancelled()).select(F.col("id").alias("order_id"))
        items = items.join(live, "order_id", "left_semi")
    sold = items.groupBy("nomenclature_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("total_price").alias("amount")
    )
    products = t.nomenclature.where("is_active").select(F.col("id").alias("nomenclature_id"), "category_id")
    joined_rows = F.lit(1) if distinct_products else F.coalesce(F.col("items"), F.lit(1))
    per_category = (
        products.join(sold, "nomenclature_id", "left")
        .groupBy(F.col("category_id").alias("id"))
        .agg(F.sum(joined_rows).alias("products"), F.sum("items").alias("items"), F.sum("amount").alias("amount"))
    )
    products_count, items_count = count_or_zero(F.col("products")), count_or_zero(F.col("items"))
    return (
        t.categories.where("is_active")
        .join(per_category, "id", "left")
        .select(
            F.col("id").alias("category_id"),
            F.col("name").alias("category"),
            "level",
            products_count.alias("products_in_category"),
            items_count.alias("items_in_orders"),
            or_zero(as_double(F.col("amount"))).alias("sales"),
            ratio(items_count, products_count).alias("ratio"),
        )
        .orderBy(F.desc("sales"), "category_id")
    )


def _named_items(t: Tables) -> DataFrame:
    products = t.nomenclature.select(F.col("id").alias("nomenclature_id"), F.col("name").alias("product_name"))
    return t.order_items.select("order_id", *{*t.item_key, "nomenclature_id"}).join(products, "nomenclature_id")


def order_details(t: Tables) -> DataFrame:
    """Orders that have items, newest first, with their product names in item order.

    One row per order; `products` is one comma list, so a row is as large as its
    order. `order_lines` has the same names one to a row.
    """
    names = F.expr(f"listagg(product_name, ', ') WITHIN GROUP (ORDER BY {', '.join(t.item_key)})")
    # Rows are brought together first, since lists gain nothing from being built on the map side.
    named = _named_items(t).repartition("order_id").groupBy("order_id")
    lists = named.agg(F.count(F.lit(1)).alias("items_count"), names.alias("products"))
    clients = t.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    return (
        t.orders.withColumnRenamed("id", "order_id")
        .join(clients, "client_id")
        .join(lists, "order_id")
        .select(
            "order_id",
            "order_number",
            "client_name",
            "order_date",
            as_double(F.col("total_amount")).alias("total_amount"),
            "status",
            "payment_status",
            "items_count",
            "products",
        )
        .orderBy(F.desc("order_date"), "order_id")
    )


def order_lines(t: Tables) -> DataFrame:
    """The lines of orders of any size: a row per item with its position in the order, from 0."""
    lines = placed(_named_items(t), ["order_id"], list(t.item_key), "order-lines")
    clients = t.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    return (
        t.orders.select(F.col("id").alias("order_id"), "order_number", "client_id")
        .join(clients, "client_id")
        .join(lines, "order_id")
        .select("order_id", "order_number", "client_name", POSITION, "nomenclature_id", "product_name")
    )


def status_stats(t: Tables) -> DataFrame:
    """Count, stored amounts and first and last date per status, cancelled included."""
    return (
        t.orders.groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("orders_count"),
            F.sum("total_amount").alias("amount"),
            F.count("total_amount").alias("amounts"),
            F.min("order_date").alias("first_order"),
            F.max("order_date").alias("last_order"),
        )
        .select(
            "status",
            "orders_count",
            as_double(F.col("amount")).alias("total_amount"),
            mean(F.col("amount"), F.col("amounts")).alias("avg_amount"),
            "first_order",
            "last_order",
        )
        .orderBy(F.desc_nulls_first("total_amount"), "status")
    )


def seasonality(t: Tables) -> DataFrame:
    """Non-cancelled orders and stored amounts per month of the year."""
    return (
        t.orders.where(not_cancelled())
        .groupBy(F.month("order_date").alias("month"), F.quarter("order_date").alias("quarter"))
        .agg(
            F.count(F.lit(1)).alias("orders_count"),
            F.sum("total_amount").alias("amount"),
            F.count("total_amount").alias("amounts"),
        )
        .select(
            "month",
            "quarter",
            "orders_count",
            as_double(F.col("amount")).alias("total_amount"),
            mean(F.col("amount"), F.col("amounts")).alias("avg_order"),
        )
        .orderBy("month")
    )


def order_stats(t: Tables) -> DataFrame:
    """One row over all non-cancelled orders, also when there are none."""
    return (
        t.orders.where(not_cancelled())
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.sum("total_amount").alias("amount"),
            F.count("total_amount").alias("amounts"),
            F.count_if(F.col("status") == "pending").alias("pending_orders"),
            F.count_if(F.col("status") == "completed").alias("completed_orders"),
        )
        .select(
            "total_orders",
            or_zero(as_double(F.col("amount"))).alias("total_amount"),
            or_zero(mean(F.col("amount"), F.col("amounts"))).alias("avg_order"),
            "pending_orders",
            "completed_orders",
        )
    )


def with_items_count(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Orders with the number of their items, 0 for none."""
    counts = order_items.groupBy(F.col("order_id").alias("id")).agg(F.count(F.lit(1)).alias("items_count"))
    return orders.join(counts, "id", "left").withColumn("items_count", count_or_zero(F.col("items_count")))


def order_summary(t: Tables) -> DataFrame:
    """The order view: header, client name and item count; empty orders stay."""
    clients = t.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    return (
        with_items_count(t.orders, t.order_items)
        .join(clients, "client_id")
        .select(
            "id",
            "order_number",
            "order_date",
            "client_name",
            as_double(F.col("total_amount")).alias("total_amount"),
            "status",
            "payment_status",
            "items_count",
        )
    )
