from __future__ import annotations

from datetime import datetime

import pytest
from helpers import tuples

from orderlytics.operators import reports

TOTALS = {2: 130000, 5: 125000, 3: 120000, 4: 115000, 1: 105000}


def test_client_summary_is_sorted_by_amount(shop):
    rows = tuples(reports.client_order_summary(shop), "client_id", "total_amount", "orders_count")
    assert rows == [(cid, float(total), 1) for cid, total in TOTALS.items()]


def test_client_summary_dates(shop):
    last = dict(tuples(reports.client_order_summary(shop), "client_id", "last_order"))
    assert last[1] == datetime(2024, 1, 15, 7, 30)


def test_client_without_orders_stays_and_cancelled_are_left_out(shop, make):
    clients = make("clients", "id, name, address, is_active", [(1, "A", "x", True), (2, "B", "x", True), (3, "C", "x", False)])
    orders = make(
        "orders",
        "id, client_id, order_number, status",
        [(1, 1, "a", "pending"), (2, 1, "b", "cancelled"), (3, 2, "c", "cancelled"), (4, 3, "d", "pending")],
    )
    items = make("order_items", "order_id, nomenclature_id, quantity, price, total_price", [(1, 1, 1, 7, 7), (2, 1, 1, 9, 9), (3, 1, 1, 9, 9)])
    t = shop.with_(clients=clients, orders=orders, order_items=items)
    assert tuples(reports.client_order_summary(t), "client_id", "total_amount", "orders_count") == [(1, 7.0, 1), (2, 0.0, 0)]
    assert tuples(reports.client_stats(t), "client_id", "avg_order") == [(1, 7.0), (2, 0.0)]
    assert sorted(tuples(reports.client_point_stats(t), "client_id", "orders_count", "total_spent")) == [(1, 1, 7.0), (3, 1, 0.0)]
    assert tuples(reports.top_clients(t), "client_id") == [(1,)]


def test_null_status_is_not_live(shop, spark):
    orders = shop.orders.selectExpr("*").withColumn("status", shop.orders.status.substr(1, 0))
    orders = orders.selectExpr(*[("CAST(NULL AS STRING) AS status" if c == "status" else c) for c in orders.columns])
    t = shop.with_(orders=orders)
    assert reports.top_clients(t).count() == 0
    assert {r.orders_count for r in reports.client_order_summary(t).collect()} == {0}


def test_equal_names_do_not_merge(shop, make):
    clients = make("clients", "id, name, address", [(1, "Same", "x"), (2, "Same", "y")])
    rows = tuples(reports.client_order_summary(shop.with_(clients=clients)), "client_id", "total_amount")
    assert rows == [(2, 130000.0), (1, 105000.0)]


def test_children_count(shop):
    rows = tuples(reports.category_children_count(shop), "category_name", "children_count", "level", "full_path")
    assert rows == [("Бытовая техника", 3, 0, "Бытовая техника"), ("Компьютеры", 2, 0, "Компьютеры")]


def test_children_count_equals_the_walk(shop):
    from orderlytics.operators.hierarchy import category_closure

    walked = category_closure(shop.categories)
    counts = {r.parent_id: r["count"] for r in walked.where("depth = 1").groupBy("parent_id").count().collect()}
    assert dict(tuples(reports.category_children_count(shop), "category_id", "children_count")) == counts


def test_top_clients(shop):
    rows = tuples(reports.top_clients(shop, 2), "client_id", "total_amount", "avg_order")
    assert rows == [(2, 130000.0, pytest.approx(43333.3333, abs=1e-3)), (5, 125000.0, pytest.approx(41666.6667, abs=1e-3))]


@pytest.mark.parametrize("limit", [0, 51])
def test_top_limits(shop, limit):
    with pytest.raises(ValueError):
        reports.top_clients(shop, limit)
    with pytest.raises(ValueError):
        reports.top_products(shop, limit)


def test_category_stats(shop):
    columns = ("category_id", "products_count", "total_quantity", "avg_price", "min_price", "max_price", "total_value")
    rows = {r[0]: r[1:] for r in tuples(reports.category_stats(shop), *columns)}
    assert rows[3] == (2, 8, 27500.0, 25000.0, 30000.0, 215000.0)
    assert rows[5] == (1, 6, 55000.0, 55000.0, 55000.0, 330000.0)
    assert rows[7] == (1, 1, 120000.0, 120000.0, 120000.0, 120000.0)
    assert rows[1] == rows[2] == rows[4] == rows[6] == (0, 0, 0.0, 0.0, 0.0, 0.0)
    empty = {r[0]: r[1:] for r in tuples(reports.category_stats(shop, zero_fill=False), *columns)}
    assert empty[1] == (0, None, None, None, None, None)
    assert tuples(reports.category_stats(shop), "category_id")[0] == (5,)


def test_sales_by_month(shop):
    assert tuples(reports.sales_by_month(shop)) == [
        (datetime(2024, 1, 1), 5, 13, 595000.0, pytest.approx(45769.230769, abs=1e-6))
    ]


def test_top_products_breaks_ties_by_id(shop):
    rows = tuples(reports.top_products(shop), "nomenclature_id", "total_sold", "total_revenue", "orders_count")
    assert rows == [
        (8, 1, 120000.0, 1),
        (5, 2, 110000.0, 2),
        (4, 2, 90000.0, 2),
        (3, 2, 70000.0, 2),
        (2, 2, 60000.0, 2),
        (1, 2, 50000.0, 2),
        (7, 1, 50000.0, 1),
        (6, 1, 45000.0, 1),
    ]
    assert tuples(reports.top_products(shop, 6), "nomenclature_id")[-1] == (1,)


def test_product_stats_count_cancelled_items_but_not_orders(shop):
    orders = shop.orders.selectExpr(*[("CASE id WHEN 3 THEN 'cancelled' ELSE status END AS status" if c == "status" else c) for c in shop.orders.columns])
    t = shop.with_(orders=orders)
    rows = {r[0]: r[1:] for r in tuples(reports.product_stats(t), "nomenclature_id", "total_sold", "total_revenue", "orders_count", "avg_price")}
    assert rows[8] == (1, 120000.0, 0, 120000.0)
    assert rows[1] == (2, 50000.0, 2, 25000.0)
    strict = {r[0]: r[1:] for r in tuples(reports.product_stats(t, True), "nomenclature_id", "total_sold", "total_revenue", "orders_count", "avg_price")}
    assert strict[8] == (0, 0.0, 0, 0.0)
    effect = {r[0]: r[1:] for r in tuples(reports.category_effectiveness(t), "category_id", "items_in_orders", "sales")}
    assert effect[7] == (1, 120000.0)
    effect = {r[0]: r[1:] for r in tuples(reports.category_effectiveness(t, exclude_cancelled_items=True), "category_id", "products_in_category", "items_in_orders", "ratio")}
    assert effect[7] == (1, 0, 0.0)


def test_category_effectiveness(shop):
    columns = ("category_id", "products_in_category", "items_in_orders", "sales", "ratio")
    rows = {r[0]: r[1:] for r in tuples(reports.category_effectiveness(shop), *columns)}
    assert rows[3] == (4, 4, 110000.0, 1.0)
    assert rows[5] == (2, 2, 110000.0, 1.0)
    assert rows[9] == (2, 2, 90000.0, 1.0)
    assert rows[1] == (0, 0, 0.0, 0.0)
    strict = {r[0]: r[1:] for r in tuples(reports.category_effectiveness(shop, distinct_products=True), *columns)}
    assert strict[3] == (2, 4, 110000.0, 2.0)


def test_order_details(shop):
    rows = tuples(reports.order_details(shop), "order_id", "items_count", "products")
    assert [r[:2] for r in rows] == [(5, 3), (4, 3), (3, 1), (2, 3), (1, 3)]
    names = dict(tuples(shop.nomenclature, "id", "name"))
    assert rows[-1][2] == ", ".join(names[i] for i in (1, 3, 4))


def test_order_lines(shop):
    lines = sorted(tuples(reports.order_lines(shop), "order_id", "position", "nomenclature_id"))
    assert lines[:3] == [(1, 0, 1), (1, 1, 3), (1, 2, 4)]
    assert [sum(r[0] == order for r in lines) for order in (1, 2, 3, 4, 5)] == [3, 3, 1, 3, 3]


def test_status_stats(shop):
    assert tuples(reports.status_stats(shop), "status", "orders_count", "total_amount", "avg_amount") == [
        ("processing", 2, 255000.0, 127500.0),
        ("completed", 2, 220000.0, 110000.0),
        ("pending", 1, 120000.0, 120000.0),
    ]


def test_seasonality_and_order_stats(shop):
    assert tuples(reports.seasonality(shop)) == [(1, 1, 5, 595000.0, 119000.0)]
    assert tuples(reports.order_stats(shop)) == [(5, 595000.0, 119000.0, 1, 2)]


def test_order_summary_keeps_orders_without_items(shop):
    t = shop.with_(order_items=shop.order_items.where("order_id <> 2"))
    assert dict(tuples(reports.order_summary(t), "id", "items_count")) == {1: 3, 2: 0, 3: 1, 4: 3, 5: 3}


def test_empty_tables(empty):
    assert reports.client_order_summary(empty).count() == 0
    assert reports.category_children_count(empty).count() == 0
    assert reports.order_details(empty).count() == 0
    assert tuples(reports.order_stats(empty)) == [(0, 0.0, 0.0, 0, 0)]
