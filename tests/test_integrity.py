from __future__ import annotations

import pytest
from helpers import tuples

from orderlytics.operators import integrity
from orderlytics.operators.integrity import VIOLATIONS, accepted, record_rules, rejected


def codes(df, key="id"):
    return {r[key]: r[VIOLATIONS] for r in df.collect()}


def test_client_rules(make):
    clients = make(
        "clients",
        "id, name, email, phone, address",
        [
            (1, "Ok", "a.b@c.example.com", "+7 900", "x"),
            (2, "", None, None, "x"),
            (3, "n" * 300, "invalid-email", None, ""),
            (4, None, "a@b", "1" * 21, None),
            (5, "n" * 255, None, None, "x"),
            (6, "x", "a..b@c.de", None, "x"),
            (7, "x", "a@@c.de", None, "x"),
        ],
    )
    checked = record_rules(clients, "clients")
    assert codes(checked) == {
        1: [],
        2: ["name_too_short"],
        3: ["name_too_long", "email_malformed", "address_too_short"],
        4: ["name_missing", "address_missing", "email_malformed", "phone_too_long"],
        5: [],
        6: ["email_malformed"],
        7: ["email_malformed"],
    }
    assert sorted(tuples(accepted(checked), "id")) == [(1,), (5,)]
    assert rejected(checked).count() == 5
    assert codes(record_rules(clients, "clients", "storage"))[3] == ["name_too_long"]
    assert codes(record_rules(clients, "clients", "patch"))[4] == ["email_malformed", "phone_too_long"]


def test_product_price_zero_is_stored_but_not_entered(make):
    products = make("nomenclature", "id, name, quantity, price, cost, category_id", [(1, "a", 0, 0, 0, 1), (2, "a", -1, -1, -1, None)])
    assert codes(record_rules(products, "nomenclature")) == {
        1: ["price_not_positive"],
        2: ["category_id_missing", "quantity_negative", "price_not_positive", "cost_negative"],
    }
    assert codes(record_rules(products, "nomenclature", "storage")) == {
        1: [],
        2: ["quantity_negative", "price_negative", "cost_negative", "category_id_missing"],
    }


def test_order_rules(make):
    orders = make("orders", "id, client_id, status, payment_status", [(1, 1, "pending", "paid"), (2, 1, "lost", "later"), (3, None, "pending", "paid"), (4, 1, "pending", "paid")])
    items = make("order_items", "order_id, nomenclature_id, quantity, price, total_price", [(1, 1, 1, 5, 5), (2, 1, 1, 5, 5), (4, 1, -1, 5, -5), (4, 2, 0, -5, 1)])
    assert codes(integrity.order_rules(orders, items)) == {
        1: [],
        2: ["status_unknown", "payment_status_unknown"],
        3: ["client_id_missing", "items_missing"],
        4: ["quantity_not_positive", "price_not_positive", "total_price_not_positive"],
    }


def test_unknown_table(make):
    with pytest.raises(ValueError):
        record_rules(make("clients", "name", [("x",)]), "invoices")


def test_foreign_keys(shop, make):
    assert integrity.fk_violations(shop).count() == 0
    items = make("order_items", "order_id, nomenclature_id, quantity, price, total_price", [(1, 99, 1, 5, 5), (2, 99, 1, 5, 5), (77, 1, 1, 5, 5)])
    found = integrity.fk_violations(shop.with_(order_items=items))
    assert sorted(tuples(found)) == [("order_items.nomenclature_id", 99, 2), ("order_items.order_id", 77, 1)]
    inactive = shop.with_(clients=shop.clients.selectExpr("* EXCEPT (is_active)", "id <> 3 AS is_active"))
    assert tuples(integrity.fk_violations(inactive, require_active=True)) == [("orders.client_id", 3, 1)]
    assert integrity.fk_violations(inactive).count() == 0


def test_unique_keys(shop, make):
    assert integrity.unique_violations(shop).count() == 0
    clients = make("clients", "id, name, email, address", [(1, "a", "e@x.y", "s"), (2, "b", "e@x.y", "s"), (3, "c", None, "s"), (4, "d", None, "s")])
    categories = make(
        "categories",
        "id, name, parent_id, is_active",
        [(1, "top", None, True), (2, "top", None, True), (3, "k", 1, True), (4, "k", 1, True), (5, "k", 2, True), (6, "k", 1, False)],
    )
    t = shop.with_(clients=clients, categories=categories)
    assert sorted(tuples(integrity.unique_violations(t))) == [
        ("categories.parent_id+name", "/top", 2),
        ("categories.parent_id+name", "1/k", 2),
        ("clients.email", "e@x.y", 2),
    ]
    strict = integrity.unique_violations(t, sibling_nulls_equal=False)
    assert sorted(tuples(strict)) == [("categories.parent_id+name", "1/k", 2), ("clients.email", "e@x.y", 2)]


def test_refused_rows_have_a_reason(shop, make):
    items = make("order_items", "id, order_id, nomenclature_id, quantity, price", [(1, 1, 99, 1, 5), (2, 77, 98, 1, 5), (3, 1, 1, 1, 5), (4, 1, 1, 2, 5)])
    t = shop.with_(order_items=items)
    assert sorted(tuples(integrity.fk_rejected(t, "order_items"), "id", "reason")) == [
        (1, "nomenclature_id_not_found"),
        (2, "nomenclature_id_not_found"),
        (2, "order_id_not_found"),
    ]
    assert integrity.fk_rejected(t, "clients").count() == integrity.fk_rejected(t, "orders").count() == 0
    reason = "order_id+nomenclature_id_repeated"
    assert sorted(tuples(integrity.unique_rejected(t, "order_items"), "id", "reason")) == [(3, reason), (4, reason)]
    assert integrity.unique_rejected(t, "clients").count() == 0


def test_total_mismatch(raw_seed, shop, make):
    assert sorted(tuples(integrity.order_total_mismatch(raw_seed))) == [(4, 80000.0, 115000.0), (5, 95000.0, 125000.0)]
    assert integrity.order_total_mismatch(shop).count() == 0
    items = make("order_items", "order_id, nomenclature_id, quantity, price, total_price", [(1, 1, 2, 5, 10), (1, 2, 2, 5, 11)])
    assert tuples(integrity.item_total_mismatch(shop.with_(order_items=items)), "total_price", "expected_price") == [(11.0, 10.0)]


def test_sibling_names_are_refused(shop, make):
    rows = [(101, "A", 1, True), (102, "A", 1, True), (103, "A", 2, True), (104, "A", 1, False), (105, "R", None, True), (106, "R", None, True)]
    t = shop.with_(categories=make("categories", "id, name, parent_id, is_active", rows))
    refused = lambda **flags: sorted(tuples(integrity.unique_rejected(t, "categories", **flags), "id", "reason"))
    assert refused() == [(n, "parent_id+name_repeated") for n in (101, 102, 105, 106)]
    assert refused(sibling_nulls_equal=False) == [(n, "parent_id+name_repeated") for n in (101, 102)]
