from __future__ import annotations

from decimal import Decimal

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from orderlytics.operators import changes
from orderlytics.operators.hierarchy import category_path


def now():
    return F.lit("2025-05-05 05:05:05").cast("timestamp")


def rejects(applied, key="seq"):
    return dict(tuples(applied.rejected, key, "reason"))


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


# --- stock, numbers, totals


def test_stock_moves_both_ways(shop, spark):
    deltas = frame(spark, "nomenclature_id bigint, delta bigint", (1, -2), (1, -3), (2, 4), (3, -3))
    applied = changes.apply_stock(shop.nomenclature, deltas, now=now())
    stock = {r.id: (r.quantity, r.updated_by) for r in applied.table.collect()}
    assert stock[1] == (0, "api_user")
    assert stock[2] == (7, "api_user")
    assert stock[3] == (2, None), "a stock below zero is refused and nothing changes"
    assert stock[4] == (4, None)
    assert rejects(applied, "id") == {3: "stock_negative"}


def test_next_number_after_the_seed(shop, make):
    new = make("orders", "id, client_id, order_number", [(100, 1, None), (101, 1, ""), (102, 1, "WEB-1")])
    numbered = changes.assign_order_numbers(shop.orders, new, ["id"])
    assert dict(tuples(numbered, "id", "order_number")) == {100: "ORD-000006", 101: "ORD-000007", 102: "WEB-1"}


def test_numbers_follow_explicit_ones(shop, make):
    given = [None, "ORD-000050", None, "ORD-7", "", "ORD-999998", None, "ORD-x", None, None, "ORD-1000005", None]
    new = make("orders", "id, client_id, order_number", [(n, 1, g) for n, g in enumerate(given)])
    numbered = changes.assign_order_numbers(shop.orders, new, ["id"])
    result = [n for _, n in sorted(tuples(numbered, "id", "order_number"))]
    highest, expected = 5, []
    for g in given:
        if not g:
            g = f"ORD-{highest + 1:06d}"
        expected.append(g)
        digits = g.removeprefix("ORD-")
        if digits.isdigit():
            highest = max(highest, int(digits))
    assert result == expected
    assert "ORD-1000000" in result, "a seventh digit is not cut off"


def test_numbers_without_existing_orders(shop, make):
    new = make("orders", "id, client_id, order_number", [(1, 1, None)])
    assert tuples(changes.assign_order_numbers(shop.orders.limit(0), new, ["id"]), "order_number") == [("ORD-000001",)]


def test_order_totals(raw_seed, spark):
    totals = changes.order_totals(raw_seed.orders, raw_seed.order_items)
    assert dict(tuples(totals, "id", "total_amount"))[4] == Decimal("115000.00")
    items = raw_seed.order_items.where("order_id <> 3")
    assert dict(tuples(changes.order_totals(raw_seed.orders, items), "id", "total_amount"))[3] == 120000
    touched = changes.order_totals(raw_seed.orders, items, frame(spark, "id bigint", (3,), (4,)))
    assert dict(tuples(touched, "id", "total_amount")) == {1: 105000, 2: 130000, 3: 0, 4: 115000, 5: 95000}


# --- patches


def test_patch_merges_and_stamps(shop, spark):
    patches = frame(
        spark,
        "seq bigint, id bigint, name string, email string, phone string, is_active boolean",
        (1, 1, "First", None, None, None),
        (2, 1, "Second", None, None, False),
        (3, 1, None, "new@example.com", None, None),
        (4, 2, None, None, None, None),
        (5, 99, "Nobody", None, None, None),
        (6, 3, "", None, None, None),
        (7, 4, None, "petrov@example.com", None, None),
        (8, 2, None, "petrov@example.com", "1", None),
        (9, 5, None, "new@example.com", None, None),
    )
    applied = changes.patch_apply("clients", shop, patches, now=now())
    rows = {r.id: r for r in applied.table.collect()}
    assert (rows[1].name, rows[1].email, rows[1].is_active, rows[1].updated_by) == ("Second", "new@example.com", False, "api_user")
    assert rows[1].phone == "+7 (495) 123-45-67"
    assert str(rows[1].updated_at) == "2025-05-05 05:05:05"
    assert (rows[2].phone, rows[2].updated_by) == ("1", "api_user")
    assert rows[3].updated_by is None
    assert rejects(applied) == {
        4: "nothing_to_change",
        5: "unknown_id",
        6: "invalid_fields",
        7: "email_taken",
        9: "email_taken",
    }
    assert applied.table.count() == 5


def test_patch_checks_the_category(shop, spark):
    t = shop.with_(categories=shop.categories.selectExpr("* EXCEPT (is_active)", "id <> 6 AS is_active"))
    patches = frame(spark, "seq bigint, id bigint, category_id bigint, price decimal(12,2)", (1, 1, 6, None), (2, 2, 5, None), (3, 3, None, Decimal(0)))
    applied = changes.patch_apply("nomenclature", t, patches)
    assert rejects(applied) == {1: "category_not_found", 3: "invalid_fields"}
    assert dict(tuples(applied.table, "id", "category_id"))[2] == 5


def test_patch_of_one_field(shop, spark):
    patches = frame(spark, "seq bigint, id bigint, parent_id bigint", (1, 7, 1), (2, 8, 50), (3, 9, None))
    applied = changes.patch_apply("categories", shop, patches)
    assert dict(tuples(applied.table, "id", "parent_id"))[7] == 1
    assert rejects(applied) == {2: "parent_not_found", 3: "nothing_to_change"}


def test_patch_order_status(shop, spark):
    patches = frame(spark, "seq bigint, id bigint, status string, notes string", (1, 1, "cancelled", None), (2, 2, "gone", None), (3, 3, None, "call"))
    applied = changes.patch_apply("orders", shop, patches)
    assert dict(tuples(applied.table, "id", "status")) == {1: "cancelled", 2: "processing", 3: "pending", 4: "completed", 5: "processing"}
    assert dict(tuples(applied.table, "id", "notes"))[3] == "call"
    assert rejects(applied) == {2: "invalid_fields"}


# --- inserts


def test_insert_clients(shop, spark):
    batch = frame(
        spark,
        "seq bigint, name string, email string, address string, is_active boolean",
        (10, "A", "a@example.com", "x", False),
        (11, "B", "a@example.com", "x", True),
        (12, "C", "ivanov@example.com", "x", True),
        (13, "D", None, "x", True),
        (14, "E", None, "x", True),
        (15, "", "e@example.com", "x", True),
        (16, "F", "e@example.com", "x", True),
    )
    applied = changes.insert_batch("clients", shop, batch, now=now())
    added = {r.id: r for r in applied.table.where("id > 5").collect()}
    assert {i: r.name for i, r in added.items()} == {6: "A", 7: "D", 8: "E", 9: "F"}
    assert added[6].is_active and added[6].created_by == "api_user" and added[6].uuid
    assert rejects(applied) == {11: "email_taken", 12: "email_taken", 15: "invalid_fields"}


def test_insert_products(shop, spark):
    batch = frame(
        spark,
        "seq bigint, name string, sku string, price decimal(12,2), category_id bigint",
        (1, "a", "NEW", Decimal(5), 3),
        (2, "b", "NEW", Decimal(5), 3),
        (3, "c", "MBA-IM24M1", Decimal(5), 3),
        (4, "d", "D", Decimal(5), 33),
        (5, "e", "", Decimal(5), 3),
        (6, "f", "", Decimal(5), 3),
    )
    applied = changes.insert_batch("nomenclature", shop, batch)
    assert rejects(applied) == {2: "sku_taken", 3: "sku_taken", 4: "category_not_found"}
    assert sorted(tuples(applied.table.where("id > 8"), "id", "name", "quantity")) == [(9, "a", 0), (10, "e", 0), (11, "f", 0)]


def test_insert_categories(shop, spark):
    batch = frame(
        spark,
        "seq bigint, name string, parent_id bigint",
        (1, "Холодильники", 1),
        (2, "Холодильники", 2),
        (3, "Компьютеры", None),
        (4, "Сад", None),
        (5, "Сад", None),
        (6, "x", 99),
    )
    applied = changes.insert_batch("categories", shop, batch)
    assert rejects(applied) == {1: "name_taken", 3: "name_taken", 5: "name_taken", 6: "parent_not_found"}
    assert sorted(tuples(applied.table.where("id > 11"), "id", "name", "parent_id")) == [(12, "Холодильники", 2), (13, "Сад", None)]
    loose = changes.insert_batch("categories", shop, batch, null_parents_equal=False)
    assert rejects(loose) == {1: "name_taken", 6: "parent_not_found"}


# --- deletes


@pytest.mark.parametrize(
    ("table", "expected"),
    [
        ("categories", {1: "has_children", 3: "has_products", 4: "has_children", 99: "unknown_id"}),
        ("clients", {1: "has_orders", 3: "has_orders", 4: "has_orders", 99: "unknown_id"}),
        ("nomenclature", {1: "in_orders", 3: "in_orders", 4: "in_orders", 99: "unknown_id"}),
        ("orders", {1: "locked_status", 4: "locked_status", 99: "unknown_id"}),
    ],
)
def test_guarded_delete(shop, spark, table, expected):
    ids = frame(spark, "id bigint", (1,), (3,), (4,), (4,), (99,))
    applied = changes.guarded_delete(table, shop, ids)
    assert rejects(applied, "id") == expected
    assert applied.table.count() == getattr(shop, table).count() - (1 if table == "orders" else 0)


def test_delete_unused(shop, spark, make):
    t = shop.with_(order_items=shop.order_items.where("nomenclature_id <> 8"), nomenclature=shop.nomenclature.where("category_id <> 7"))
    ids = frame(spark, "id bigint", (7,))
    assert sorted(tuples(changes.guarded_delete("categories", t, ids).table, "id"))[6] == (8,)
    gone = changes.guarded_delete("nomenclature", shop.with_(order_items=t.order_items), frame(spark, "id bigint", (8,)))
    assert gone.table.count() == 7


def test_inactive_children_still_guard(make, shop, spark):
    nodes = make("categories", "id, name, parent_id, is_active", [(1, "a", None, True), (2, "b", 1, False)])
    applied = changes.guarded_delete("categories", shop.with_(categories=nodes), frame(spark, "id bigint", (1,), (2,)))
    assert rejects(applied, "id") == {1: "has_children"}


def test_cascade_returns_stock(shop, spark):
    done = changes.cascade_delete(shop, frame(spark, "id bigint", (3,), (1,), (4,)))
    assert sorted(tuples(done.orders, "id")) == [(2,), (5,)]
    assert {i for (i,) in tuples(done.order_items, "order_id")} == {2, 5}
    assert dict(tuples(done.stock_deltas, "nomenclature_id", "delta")) == {8: 1, 1: 2, 3: 2, 4: 1, 5: 1}
    stock = changes.apply_stock(shop.nomenclature, done.stock_deltas).table
    assert dict(tuples(stock, "id", "quantity"))[8] == 2


def test_categories_take_their_place_from_the_parent(shop, spark):
    stored = shop.with_(categories=shop.categories.drop("path", "level").join(category_path(shop.categories), "id"))
    new = frame(spark, "seq bigint, name string, parent_id bigint", (1, "deep", 4), (2, "top", None))
    added = changes.insert_batch("categories", stored, new).table.where("name IN ('deep', 'top')")
    assert sorted(tuples(added, "id", "path", "level")) == [(12, "1.4.12", 2), (13, "13", 0)]
    moves = frame(spark, "seq bigint, id bigint, parent_id bigint", (1, 8, 2))
    moved = {r.id: (r.path, r.level) for r in changes.patch_apply("categories", stored, moves).table.collect()}
    assert (moved[8], moved[9]) == (("2.8", 1), ("1.4.9", 2))
