from __future__ import annotations

from datetime import datetime

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from orderlytics.operators import search


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture
def people(shop, make):
    rows = [
        (1, "Anna", "anna@example.com", None, True),
        (2, "Boris", None, "+7 900", True),
        (3, "anton", "x@y.z", None, True),
        (4, "Clara", "clara@example.com", None, False),
        (5, "Dan_a", None, None, None),
    ]
    clients = make("clients", "id, name, email, phone, address", [(*r[:4], "street") for r in rows])
    flags = clients.sparkSession.createDataFrame([(r[0], r[4]) for r in rows], "id bigint, flag boolean")
    clients = clients.drop("is_active").join(flags, "id").withColumnRenamed("flag", "is_active")
    return shop.with_(clients=clients)


def test_client_search_text(people):
    assert ids(search.client_search(people, "AN")) == [1, 3]
    assert ids(search.client_search(people, "900")) == [2]
    assert ids(search.client_search(people, "example", is_active=False)) == [4]
    assert ids(search.client_search(people, "A_n", number=None)) == [1]
    assert ids(search.client_search(people, "%", number=None)) == [1, 2, 3]


def test_unset_flag_matches_no_client_or_product(people):
    assert ids(search.client_search(people, is_active=None)) == []
    assert ids(search.product_search(people, is_active=None)) == []
    assert len(ids(search.category_list(people, is_active=None, size=100))) == 11


def test_client_search_spend(shop):
    rows = tuples(search.client_search(shop, "иванов"), "id", "orders_count", "total_spent")
    assert rows == [(1, 1, 105000.0)]
    everyone = tuples(search.client_search(shop, number=None), "id", "orders_count", "total_spent")
    assert everyone == tuples(search.client_search(shop), "id", "orders_count", "total_spent")


def test_client_by_ids_includes_inactive(people, spark):
    rows = search.client_by_ids(people, spark.createDataFrame([(4,), (4,), (77,)], "id bigint"))
    assert tuples(rows, "id", "orders_count", "total_spent") == [(4, 1, 115000.0)]


def test_product_search(shop):
    assert ids(search.product_search(shop, "samsung")) == [1, 5, 4]
    assert ids(search.product_search(shop, "SMS-")) == [1]
    assert ids(search.product_search(shop, "NoFrost")) == [3]
    assert sorted(ids(search.product_search(shop, category_id=3))) == [1, 2]
    assert len(ids(search.product_search(shop, category_id=0))) == 8
    assert sorted(ids(search.product_search(shop, min_price=45000, max_price=50000))) == [4, 6, 7]
    assert ids(search.product_search(shop, max_price=0)) == []
    assert tuples(search.product_search(shop, "LG"), "category_name") == [("Стиральные машины",)]


def test_in_stock(shop):
    stock = shop.nomenclature.withColumn("quantity", F.when(F.col("id") == 1, 0).otherwise(F.col("quantity")))
    t = shop.with_(nomenclature=stock)
    assert sorted(ids(search.product_search(t, category_id=3, in_stock=True))) == [2]
    assert sorted(ids(search.product_search(t, category_id=3, in_stock=False))) == [1, 2]


def test_order_search(shop):
    assert ids(search.order_search(shop)) == [5, 4, 3, 2, 1]
    assert ids(search.order_search(shop, client_id=1)) == [1]
    assert len(ids(search.order_search(shop, client_id=0))) == 5
    assert ids(search.order_search(shop, status="completed")) == [4, 1]
    assert ids(search.order_search(shop, payment_status="paid")) == [5, 4, 1]
    assert ids(search.order_search(shop, min_amount=120000, max_amount=125000)) == [5, 3]
    assert ids(search.order_search(shop, max_amount=0)) == []
    assert ids(search.order_search(shop, date_from=datetime(2024, 1, 17), date_to=datetime(2024, 1, 18, 8, 45))) == [4, 3]
    assert tuples(search.order_search(shop, client_id=2), "client_name", "items_count") == [("Петров Петр Петрович", 3)]
    with pytest.raises(ValueError):
        search.order_search(shop, status="lost")


def test_order_pages(shop):
    assert [ids(search.order_search(shop, number=n, size=2)) for n in (1, 2, 3, 4)] == [[5, 4], [3, 2], [1], []]


def test_category_list(shop):
    counts = dict(tuples(search.category_list(shop, size=100), "id", "children_count"))
    assert counts == {1: 3, 2: 2, 4: 2, 6: 2, 3: 0, 5: 0, 7: 0, 8: 0, 9: 0, 10: 0, 11: 0}


def test_by_ids(shop, spark):
    wanted = spark.createDataFrame([(4,), (6,)], "id bigint")
    assert sorted(tuples(search.category_by_ids(shop, wanted), "id", "children_count")) == [(4, 2), (6, 2)]
    assert sorted(tuples(search.product_by_ids(shop, wanted), "id", "category_name")) == [(4, "двухкамерные"), (6, '17"')]
    assert sorted(tuples(search.order_items_count(shop, wanted), "id", "client_name", "items_count")) == [(4, "Козлова Анна Сергеевна", 3)]


def test_order_with_items(shop, spark):
    t = shop.with_(order_items=shop.order_items.where("order_id <> 3"))
    rows = search.order_with_items(t).orderBy("id", "position").collect()
    first = [r for r in rows if r.id == 1]
    assert [(r.items_count, r.position, r["item"].nomenclature_id) for r in first] == [(3, 0, 1), (3, 1, 3), (3, 2, 4)]
    assert first[0]["item"].nomenclature_sku == "SMS-WW90T4540AE"
    assert [(r.items_count, r.position, r["item"]) for r in rows if r.id == 3] == [(0, None, None)]
    one = search.order_with_items(t, spark.createDataFrame([(2,)], "id bigint")).collect()
    assert sorted((r.id, r.items_count, r.position) for r in one) == [(2, 3, 0), (2, 3, 1), (2, 3, 2)]


@pytest.mark.parametrize("top_rows", [100_000, 0])
def test_pages_cover_everything_once(spark, top_rows):
    rows = spark.range(57).selectExpr("id", "id % 7 AS bucket")
    seen = []
    for number in range(1, 8):
        found = search.page(rows, [F.desc("bucket"), "id"], number, 10, top_rows=top_rows)
        seen += tuples(found, "bucket", "id")
    assert seen == sorted(((n % 7, n) for n in range(57)), key=lambda r: (-r[0], r[1]))


def test_page_bounds(spark):
    rows = spark.range(5)
    for number, size in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            search.page(rows, ["id"], number, size)


def test_page_after_and_totals(spark):
    rows = spark.range(45)
    assert ids(search.page_after(rows, "id", None, 3)) == [0, 1, 2]
    assert ids(search.page_after(rows, "id", 42, 5)) == [43, 44]
    assert tuples(search.page_totals(rows, 20)) == [(45, 3)]
    assert tuples(search.page_totals(rows.limit(0), 20)) == [(0, 0)]


def test_deep_pages_read_few_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS rank")
        for number in (1, 4, 50, 51):
            found = tuples(search.page(rows, ["rank"], number, 20, top_rows=10), "rank")
            assert found == [(n,) for n in range((number - 1) * 20, min(number * 20, 1000))]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_names_in_language_order(shop, make):
    names = ["Яблоко", "ёлка", "абрикос", "Банан"]
    t = shop.with_(clients=make("clients", "name, address", [(n, "x") for n in names]))
    order = [r.name for r in search.client_search(t, collation="ru").collect()]
    assert order == ["абрикос", "Банан", "ёлка", "Яблоко"]
    assert [r.name for r in search.client_search(t).collect()] == sorted(names)


def test_bounds_reach_the_files(spark, shop):
    from datetime import timedelta, timezone

    from orderlytics.session import cut_lineage

    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    t = shop.with_(orders=cut_lineage(shop.orders, "orders"))
    east = timezone(timedelta(hours=3))
    bounds = {"date_from": datetime(2024, 1, 17, 9, 15, tzinfo=east), "date_to": datetime(2024, 1, 18, 9, 0), "min_amount": 100000.5}
    found = search.order_search(t, status="pending", number=None, **bounds)
    assert ids(found) == [3]
    plan = found._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    for part in ("EqualTo(status,pending)", "GreaterThanOrEqual(order_date", "LessThanOrEqual(order_date", "GreaterThanOrEqual(total_amount,100000.50)"):
        assert part in pushed
