"""Order intake against a loop that takes the orders one by one."""

from __future__ import annotations

import random
from datetime import datetime
from decimal import Decimal

import pytest
from helpers import tuples

from orderlytics.operators import intake, orders
from orderlytics.operators.intake import order_intake

NOON = datetime(2024, 5, 1, 12)


def serial(orders, items, clients, products):
    stock = {p: [quantity, price] for p, quantity, price, active in products if active}
    active = {c for c, ok in clients if ok}
    lines = {}
    for key, order, product, quantity, price in sorted(items):
        lines.setdefault(order, []).append((product, quantity, price))
    result = {}
    for order, client in sorted(orders):
        basket = lines.get(order, [])
        verdict = None
        if not basket:
            verdict = ("items_missing", None)
        elif any(q is None or q <= 0 or price is None or price < 0 for _, q, price in basket):
            verdict = ("invalid_fields", None)
        elif client not in active:
            verdict = ("client_not_found", None)
        for product, quantity, price in basket if verdict is None else []:
            if product not in stock:
                verdict = ("product_not_found", product)
            elif stock[product][0] < quantity:
                verdict = ("stock_too_small", product)
            elif stock[product][1] != price:
                verdict = ("price_changed", product)
            if verdict:
                break
        if verdict is None and len({p for p, _, _ in basket}) < len(basket):
            verdict = ("product_repeated", None)
        if verdict is None:
            for product, quantity, _ in basket:
                stock[product][0] -= quantity
        result[order] = verdict
    return result


def decide(spark, orders, items, clients, products, serial_lines=intake.SERIAL_LINES):
    o = spark.createDataFrame(orders, "id bigint, client_id bigint")
    i = spark.createDataFrame(items, "id bigint, order_id bigint, nomenclature_id bigint, quantity int, price decimal(12,2)")
    c = spark.createDataFrame(clients, "id bigint, is_active boolean")
    p = spark.createDataFrame(products, "id bigint, quantity int, price decimal(12,2), is_active boolean")
    rows = tuples(order_intake(o, i, c, p, ["id"], serial_lines=serial_lines), "id", "accepted", "reason", "nomenclature_id")
    assert all(ok == (reason is None) for _, ok, reason, _ in rows)
    return {r[0]: None if r[1] else (r[2], r[3]) for r in rows}


def batch(rng, worlds, orders_each, products_each, hot=False):
    """Independent small shops side by side; with `hot`, one product is in a third of all orders."""
    orders, items, products = [], [], []
    clients = [(1, True), (2, True), (3, False)]
    for world in range(worlds):
        own = [world * 100 + n for n in range(products_each)]
        products += [(p, rng.randrange(0, 12), Decimal(rng.randrange(1, 5)), rng.random() > 0.08) for p in own]
    prices = {p: price for p, _, price, _ in products}
    if hot:
        products[0] = (0, 40 * worlds, products[0][2], True)
    for n in range(worlds * orders_each):
        world = rng.randrange(worlds)
        orders.append((n, rng.choice([1, 1, 1, 2, 2, 2, 3, 4]) if rng.random() < 0.3 else 1))
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            product = world * 100 + rng.randrange(products_each + (rng.random() < 0.05))
            if hot and rng.random() < 0.33:
                product = 0
            price = prices.get(product, Decimal(1)) + (rng.random() < 0.05)
            items.append((rng.randrange(10**9), n, product, rng.randrange(1, 7), Decimal(price)))
    return orders, items, clients, products


@pytest.mark.parametrize("seed, serial_lines", [(1, 25), (2, 150), (2, 10**6)])
def test_equals_serial_intake(spark, seed, serial_lines):
    """In rounds and many stretches, in rounds and a few, and in one walk."""
    data = batch(random.Random(seed), worlds=60, orders_each=9, products_each=3)
    expected = serial(*data)
    assert decide(spark, *data, serial_lines) == expected
    assert len({v[0] for v in expected.values() if v}) == 6, "the batch must meet every reason"


def test_hot_product(spark, monkeypatch):
    """A third of all lines want one product, and slices and rewrites are forced to be small."""
    monkeypatch.setattr(intake, "ROUNDS_PER_REWRITE", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = batch(random.Random(3), worlds=20, orders_each=25, products_each=4, hot=True)
        assert decide(spark, *data, 100) == serial(*data)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def jobs_of(spark, work):
    """Spark jobs that a piece of work ran."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        result = work()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def chain(length):
    """Each order shares a product with the one before and one with the next: every decision waits for the last."""
    price = Decimal(1)
    orders = [(n, 1) for n in range(length)]
    items = [(2 * n + k, n, n + k, 1, price) for n in range(length) for k in (0, 1)]
    return orders, items, [(1, True)], [(n, 1, price, True) for n in range(length + 1)]


def test_a_long_chain_takes_as_many_jobs_as_a_short_one(spark):
    (decided, jobs), (_, few) = (jobs_of(spark, lambda n=n: decide(spark, *chain(n), 8_000)) for n in (10_000, 3_000))
    assert all((decided[n] is None) == (n % 2 == 0) for n in range(10_000))
    assert jobs <= few + 30  # three stretches instead of one


def test_a_refused_order_takes_no_stock(spark):
    orders = [(1, 1), (2, 1), (3, 1), (4, 1)]
    items = [(1, 1, 1, 3, Decimal(5)), (2, 1, 2, 9, Decimal(5)), (3, 2, 1, 4, Decimal(5)), (4, 3, 1, 2, Decimal(5)), (5, 4, 1, 1, Decimal(5))]
    products = [(1, 5, Decimal(5), True), (2, 1, Decimal(5), True)]
    assert decide(spark, orders, items, [(1, True)], products) == {
        1: ("stock_too_small", 2),
        2: None,
        3: ("stock_too_small", 1),
        4: None,
    }


def test_reasons_of_the_single_order_cases(spark):
    products = [(1, 5, Decimal(25000), True)]
    orders = [(1, 999), (2, 1), (3, 1), (4, 1), (5, 1)]
    items = [
        (1, 1, 1, 1, Decimal(25000)),
        (2, 2, 999, 1, Decimal(25000)),
        (3, 3, 1, 100, Decimal(25000)),
        (4, 4, 1, 1, Decimal(20000)),
        (5, 5, 1, 5, Decimal(25000)),
    ]
    assert decide(spark, orders, items, [(1, True)], products) == {
        1: ("client_not_found", None),
        2: ("product_not_found", 999),
        3: ("stock_too_small", 1),
        4: ("price_changed", 1),
        5: None,
    }


def test_invalid_lines_are_refused_with_a_reason_and_touch_no_stock(spark):
    price = Decimal("2.00")
    orders = [(n, 1 if n < 7 else 9) for n in range(1, 9)]
    bad = [(1, -3, price), (2, 0, price), (3, None, price), (4, 1, None), (5, 1, Decimal("-1.00")), (8, -1, price)]
    items = [(n, order, 10, quantity, p) for n, (order, quantity, p) in enumerate(bad)]
    items += [(20, 6, 10, 7, price), (21, 7, 10, 1, price)]
    world = (orders, items, [(1, True)], [(10, 5, price, True)])
    decided = decide(spark, *world)
    assert decided == serial(*world)
    assert decided[1] == ("invalid_fields", None) and decided[6] == ("stock_too_small", 10)


def test_orders_are_created_and_deleted_with_all_that_hangs_on_them(shop, make, spark):
    new = make("orders", "id, client_id, order_date, status", [(11, 1, NOON, "pending"), (12, 1, NOON, "pending"), (13, 1, NOON, "lost")])
    product = shop.nomenclature.where("id = 1").first()
    lines = make(
        "order_items",
        "id, order_id, nomenclature_id, quantity, price",
        [(101, 11, 1, 1, product.price), (102, 12, 1, product.quantity, product.price), (103, 13, 1, 1, product.price)],
    )
    made = orders.create_orders(shop, new, lines, ["order_date", "id"])
    assert sorted(tuples(made.rejected, "id", "reason")) == [(12, "stock_too_small"), (13, "invalid_fields")]
    (added,) = made.orders.where("id > 10").collect()
    assert (added.id, added.total_amount, added.payment_status) == (11, product.price, "unpaid")
    assert added.order_number > shop.orders.selectExpr("max(order_number)").first()[0]
    assert made.order_items.where("order_id > 10").count() == 1
    assert made.nomenclature.where("id = 1").first().quantity == product.quantity - 1

    after = shop.with_(orders=made.orders, order_items=made.order_items, nomenclature=made.nomenclature)
    gone = orders.delete_orders(after, spark.createDataFrame([(11,), (99,), (None,)], "id bigint"))
    assert sorted(tuples(gone.rejected, "id", "reason"), key=str) == [(99, "unknown_id"), (None, "unknown_id")]
    assert sorted(tuples(gone.orders, "id")) == sorted(tuples(shop.orders, "id"))
    assert gone.order_items.count() == shop.order_items.count()
    assert gone.nomenclature.where("id = 1").first().quantity == product.quantity


def test_taken_ids_and_numbers_are_refused_in_order_of_arrival(shop, make, spark):
    """Against a loop over the batch; refused orders leave no items and no stock."""
    stored = shop.orders.select("id", "order_number").first()
    batch = [
        (stored.id, None), (21, stored.order_number), (22, "WEB-1"), (23, "WEB-1"), (24, "ORD-777777"), (25, ""),
        (26, None), (26, "WEB-2"), (27, "WEB-2"), (28, "WEB-3"), (None, None), (None, "WEB-9"),
    ]
    rows = [(i, 1, NOON, "pending", n, k) for k, (i, n) in enumerate(batch)]
    new = spark.createDataFrame(rows, "id bigint, client_id bigint, order_date timestamp, status string, order_number string, place int")
    new = new.withColumn("order_date", new["order_date"].cast(shop.orders.schema["order_date"].dataType))
    product = shop.nomenclature.where("id = 1").first()
    ids = sorted({i for i, _ in batch if i is not None})
    lines = make("order_items", "id, order_id, nomenclature_id, quantity, price", [(200 + i, i, 1, 1, product.price) for i in ids])
    made = orders.create_orders(shop, new, lines, ["place"])

    ids_seen, numbers_seen, refused = {r.id for r in shop.orders.collect()}, {r.order_number for r in shop.orders.collect()}, []
    for i, n in batch:
        if i is None:
            refused.append((i, "invalid_fields"))
        elif i in ids_seen:
            refused.append((i, "id_taken"))
        else:
            ids_seen.add(i)
            if n in numbers_seen:
                refused.append((i, "number_taken"))
            elif n and n.startswith("ORD-"):
                refused.append((i, "number_reserved"))
            elif n:
                numbers_seen.add(n)
    assert sorted(tuples(made.rejected, "id", "reason"), key=str) == sorted(refused, key=str)
    kept = [i for i in ids if i > 20 and (i, "number_taken") not in refused and (i, "number_reserved") not in refused]
    assert sorted(r.id for r in made.orders.where("id > 20").collect()) == kept
    numbers = [r.order_number for r in made.orders.collect()]
    assert len(set(numbers)) == len(numbers) and {"WEB-1", "WEB-2", "WEB-3"} <= set(numbers)
    assert sorted(r.order_id for r in made.order_items.where("id > 200").collect()) == kept
    assert made.nomenclature.where("id = 1").first().quantity == product.quantity - len(kept)


def test_items_meet_orders_and_verdicts_in_few_shuffles(spark, monkeypatch):
    """The items are shuffled to their orders once; only lines of possible orders go there again, for the verdicts."""
    from orderlytics.operators import intake

    kept = {}

    def remember(df, group, order, label="sliced", at=None):
        kept[label] = sliced(df, group, order, label, at)
        return kept[label]

    sliced = intake.sliced
    monkeypatch.setattr(intake, "sliced", remember)
    orders = spark.createDataFrame([(1, 7, 1), (2, 8, 2)], "id bigint, client_id bigint, at int")
    items = spark.createDataFrame(
        [(1, 1, 10, 2, 5.0), (2, 2, 10, 2, 5.0)], "id bigint, order_id bigint, nomenclature_id bigint, quantity int, price double"
    )
    clients = spark.createDataFrame([(7, True), (7, True), (8, False)], "id bigint, is_active boolean")
    products = spark.createDataFrame([(10, 3, 5.0, True)], "id bigint, quantity int, price double, is_active boolean")
    found = intake.order_intake(orders, items, clients, products, ["at", "id"]).collect()
    # The client that stands twice makes its order be told of twice, and neither its lines nor the stock they take.
    lines = {(r.order_id, r.possible) for r in kept["intake-lines"].collect()}
    assert lines == {(1, True), (2, False)} and kept["intake-lines"].count() == 2
    assert {(r.id, r.accepted, r.reason) for r in found} == {(1, True, None), (2, False, "client_not_found")}
    assert "_arrival1" not in kept["intake-lines"].columns
