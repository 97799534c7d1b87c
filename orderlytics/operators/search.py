"""Filtered lists, lookups by id, and pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.functions.measures import as_double, count_or_zero, or_zero
from orderlytics.functions.predicates import (
    all_of,
    amount,
    contains_text,
    moment,
    require_payment_status,
    require_status,
)
from orderlytics.operators.reports import client_totals, with_items_count
from orderlytics.operators.running import POSITION, SLICE, placed, sliced
from orderlytics.session import cut_lineage
from orderlytics.sources.tables import Tables

MAX_PAGE_SIZE = 100
# A page within this many first rows is a top-k: every input partition sends its
# first rows to one task, so their number must stay small. A deeper page sorts in
# parallel instead.
TOP_ROWS = 2_000


def page(
    df: DataFrame, order: Sequence[str | Column], number: int = 1, size: int = 20, top_rows: int = TOP_ROWS
) -> DataFrame:
    """Rows of one page. The order must be total, so that pages do not overlap."""
    _check_page(number, size)
    skip = (number - 1) * size
    if skip + size <= top_rows:
        return df.orderBy(*order).offset(skip).limit(size)
    return _deep_page(df, order, skip, size)


def _deep_page(df: DataFrame, order: Sequence[str | Column], skip: int, size: int) -> DataFrame:
    """Range partition, count the slices, and sort only those the page lies in."""
    rows = sliced(df, [], order, "page")
    # One small row per slice comes to the driver.
    sizes = sorted(tuple(r) for r in rows.groupBy(SLICE).agg(F.count(F.lit(1))).collect())
    before, first, wanted = 0, 0, []
    for number, length in sizes:
        if before < skip + size and before + length > skip:
            first = first if wanted else before
            wanted.append(number)
        before += length
    found = rows.where(F.col(SLICE).isin(wanted)).orderBy(*order)
    return found.offset(max(skip - first, 0)).limit(size).drop(SLICE)


def page_after(df: DataFrame, key: str, last: object | None, size: int = 20) -> DataFrame:
    """The page that follows the row with unique key `last`; no skipped rows are read."""
    _check_page(1, size)
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(size)


def page_totals(df: DataFrame, size: int = 20) -> DataFrame:
    """One row: how many rows there are and how many pages they fill."""
    _check_page(1, size)
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.ceil(total / size).cast("bigint").alias("pages"))


def _check_page(number: int, size: int) -> None:
    if number < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"size must be between 1 and {MAX_PAGE_SIZE}")


def _paged(df: DataFrame, order: Sequence[str | Column], number: int | None, size: int) -> DataFrame:
    """All rows in order when no page is asked for."""
    return df.orderBy(*order) if number is None else page(df, order, number, size)


def _fixed_page(df: DataFrame, order: Sequence[str | Column], number: int, size: int) -> DataFrame:
    """A page as a small table of its own, to be joined and sorted again.

    Its true size lets the joins with large tables broadcast it, and it is
    computed once. Sorting a joined top-k again by the same keys inside one
    adaptive plan must be avoided: Spark may take it for sorted and drop the
    second sort although a shuffle lies between.
    """
    return cut_lineage(page(df, order, number, size), "page")


def _by_name(collation: str | None) -> list[Column]:
    """Order by name, byte by byte or by the rules of a language such as `ru`, then by id."""
    name = F.col("name")
    return [F.asc("name") if collation is None else F.collate(name, collation).asc(), F.asc("id")]


def _flag(is_active: bool | None) -> Column:
    """Comparison with a missing flag is unknown: it keeps no row."""
    return F.col("is_active") == F.lit(is_active).cast("boolean")


def _by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_semi")


def _with_spend(clients: DataFrame, t: Tables) -> DataFrame:
    totals = client_totals(t).select(F.col("client_id").alias("id"), F.col("orders"), F.col("amount"))
    return clients.join(totals, "id", "left").select(
        *clients.columns,
        count_or_zero(F.col("orders")).alias("orders_count"),
        or_zero(as_double(F.col("amount"))).alias("total_spent"),
    )


def client_search(
    t: Tables,
    query: str | None = None,
    is_active: bool | None = True,
    number: int | None = 1,
    size: int = 20,
    collation: str | None = None,
) -> DataFrame:
    """Clients by text in name, email or phone, with order count and spend."""
    conditions = [_flag(is_active)]
    if query:
        conditions.append(contains_text(query, "name", "email", "phone"))
    found = t.clients.where(all_of(conditions))
    by_name = _by_name(collation)
    if number is None:
        return _with_spend(found, t).orderBy(*by_name)
    # The order only needs client columns, so the page is cut first and the
    # totals are computed for its rows alone.
    rows = _fixed_page(found, by_name, number, size)
    return client_by_ids(t.with_(clients=rows), rows).orderBy(*by_name)


def client_by_ids(t: Tables, ids: DataFrame) -> DataFrame:
    """Clients with the given ids, active or not, with order count and spend."""
    clients = _by_ids(t.clients, ids)
    # Only orders of these clients, and only items of those orders, are summed.
    orders = t.orders.join(clients.select(F.col("id").alias("client_id")), "client_id", "left_semi")
    items = t.order_items.join(orders.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    return _with_spend(clients, t.with_(orders=orders, order_items=items))


def _with_category_name(products: DataFrame, t: Tables) -> DataFrame:
    names = t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return products.join(names, "category_id").select(*products.columns, "category_name")


def product_search(
    t: Tables,
    query: str | None = None,
    category_id: int | None = None,
    min_price: Decimal | float | None = None,
    max_price: Decimal | float | None = None,
    in_stock: bool | None = None,
    is_active: bool | None = True,
    number: int | None = 1,
    size: int = 20,
    collation: str | None = None,
) -> DataFrame:
    """Products by text, category, price range and stock, with their category name.

    A category of 0 and `in_stock=False` filter nothing; a price bound of 0 does.
    """
    conditions = [_flag(is_active)]
    if query:
        conditions.append(contains_text(query, "name", "sku", "description"))
    if category_id:
        conditions.append(F.col("category_id") == category_id)
    if min_price is not None:
        conditions.append(F.col("price") >= amount(min_price))
    if max_price is not None:
        conditions.append(F.col("price") <= amount(max_price))
    if in_stock:
        conditions.append(F.col("quantity") > 0)
    found = _with_category_name(t.nomenclature.where(all_of(conditions)), t)
    return _paged(found, _by_name(collation), number, size)


def product_by_ids(t: Tables, ids: DataFrame) -> DataFrame:
    return _with_category_name(_by_ids(t.nomenclature, ids), t)


def _with_client_name(orders: DataFrame, t: Tables) -> DataFrame:
    names = t.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    return orders.join(names, "client_id").select(*orders.columns, "client_name")


def order_search(
    t: Tables,
    client_id: int | None = None,
    status: str | None = None,
    payment_status: str | None = None,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
    min_amount: Decimal | float | None = None,
    max_amount: Decimal | float | None = None,
    number: int | None = 1,
    size: int = 20,
) -> DataFrame:
    """Orders by client, states, date and amount range, newest first.

    Bounds are inclusive; a client of 0 filters nothing, an amount of 0 does.
    """
    conditions: list[Column] = []
    date_type = t.orders.schema["order_date"].dataType
    if client_id:
        conditions.append(F.col("client_id") == client_id)
    if status:
        conditions.append(F.col("status") == require_status(status))
    if payment_status:
        conditions.append(F.col("payment_status") == require_payment_status(payment_status))
    if date_from:
        conditions.append(F.col("order_date") >= moment(date_from, date_type))
    if date_to:
        conditions.append(F.col("order_date") <= moment(date_to, date_type))
    if min_amount is not None:
        conditions.append(F.col("total_amount") >= amount(min_amount))
    if max_amount is not None:
        conditions.append(F.col("total_amount") <= amount(max_amount))
    newest = [F.desc("order_date"), F.asc("id")]
    found = t.orders.where(all_of(conditions))
    if number is None:
        return with_items_count(_with_client_name(found, t), t.order_items).orderBy(*newest)
    rows = _fixed_page(_with_client_name(found, t), newest, number, size)
    # Items are counted for the orders on the page only.
    items = t.order_items.join(rows.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    return with_items_count(rows, items).orderBy(*newest)


def category_list(
    t: Tables,
    is_active: bool | None = None,
    number: int | None = 1,
    size: int = 20,
    collation: str | None = None,
) -> DataFrame:
    """Categories with the number of active direct children; no flag keeps all."""
    found = t.categories if is_active is None else t.categories.where(_flag(is_active))
    return _paged(_with_children_count(found, t), _by_name(collation), number, size)


def _with_children_count(categories: DataFrame, t: Tables) -> DataFrame:
    children = (
        t.categories.where("is_active")
        .groupBy(F.col("parent_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("children_count"))
    )
    return categories.join(children, "id", "left").select(
        *categories.columns, count_or_zero(F.col("children_count")).alias("children_count")
    )


def category_by_ids(t: Tables, ids: DataFrame) -> DataFrame:
    return _with_children_count(_by_ids(t.categories, ids), t)


def order_with_items(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Orders with client name and item count, a row per item with its position in the order, from 0.

    An order without items is one row whose `position` and `item` are NULL.
    """
    orders, items = t.orders, t.order_items
    if ids is not None:
        orders = _by_ids(orders, ids)
        items = items.join(ids.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    products = t.nomenclature.select(
        F.col("id").alias("nomenclature_id"),
        F.col("name").alias("nomenclature_name"),
        F.col("sku").alias("nomenclature_sku"),
    )
    named = items.join(products, "nomenclature_id")
    key = list(t.item_key)
    item = F.struct(*[c for c in named.columns if c != "order_id"]).alias("item")
    lines = placed(named, ["order_id"], key, "order-items", total="items_count")
    lines = lines.select(F.col("order_id").alias("id"), "items_count", POSITION, item)
    orders = _with_client_name(orders, t)
    return (
        orders.join(lines, "id", "left")
        .select(*orders.columns, count_or_zero(F.col("items_count")).alias("items_count"), POSITION, "item")
    )


def order_items_count(t: Tables, ids: DataFrame) -> DataFrame:
    """Client name and item count of the given orders."""
    orders = _with_client_name(_by_ids(t.orders, ids).select("id", "client_id"), t)
    items = t.order_items.join(orders.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    return with_items_count(orders, items).select("id", "client_name", "items_count")
