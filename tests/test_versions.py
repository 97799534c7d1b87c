from __future__ import annotations

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from orderlytics.operators import changes, orders
from orderlytics.sources.versions import VersionedTable


def names(table, version=None):
    return {(f.part, f.name) for f in table.files(version).collect()}


def test_a_patch_of_ten_rows_rewrites_at_most_ten_files(spark, shop, make, tmp_path):
    clients = make("clients", "id, name, email", [(n, f"c{n}", f"c{n}@x.ru") for n in range(1, 2001)])
    table = VersionedTable.create(clients, str(tmp_path / "clients"), file_rows=20)
    before = names(table)
    assert len(before) >= 100
    patches = spark.createDataFrame([(n, 190 * n, f"new{n}") for n in range(1, 11)], "seq bigint, id bigint, name string")
    t = shop.with_(clients=table.read())
    applied = changes.patch_apply("clients", t, patches)
    assert table.commit(applied.changed) == 1
    assert 1 <= len(before - names(table)) <= 10
    columns = ("id", "name", "email", "is_active", "updated_by")
    assert sorted(tuples(table.read(), *columns)) == sorted(tuples(applied.table, *columns))
    # The version before is as it was, and its readers keep their files.
    assert names(table, 0) == before
    assert sorted(tuples(table.read(0), "id", "name")) == sorted(tuples(clients, "id", "name"))


def test_new_rows_deletes_and_forgetting(spark, tmp_path):
    rows = spark.range(1, 301).select("id", F.concat(F.lit("n"), "id").alias("name"))
    table = VersionedTable.create(rows, str(tmp_path / "t"), file_rows=10)
    first = names(table)
    added = spark.createDataFrame([(900, "x"), (901, "y"), (7, "seven")], "id bigint, name string")
    table.commit(added, gone=spark.createDataFrame([(901,), (5000,), (300,), (300,)], "id bigint"))
    got = dict(tuples(table.read(), "id", "name"))
    assert len(got) == 300 and got[900] == "x" and got[7] == "seven" and 901 not in got and 300 not in got
    assert len(first - names(table)) == 2
    shared = names(table)
    assert table.commit() == 2 and names(table) == shared
    # A commit that failed before its list was written is no version.
    (tmp_path / "t" / "versions" / "0000000003").mkdir()
    assert table.versions() == [0, 1, 2] and table.commit(gone=spark.range(1, 400)) == 3
    assert table.read().where("id < 400").isEmpty() and table.read().count() == 1
    table.forget(keep=2)
    assert table.versions() == [2, 3] and len(tuples(table.read(2), "id")) == 300
    with pytest.raises(ValueError, match="no version 0"):
        table.read(0)
    with pytest.raises(ValueError, match="already"):
        VersionedTable.create(rows, str(tmp_path / "t"))


def test_empty_table(spark, tmp_path):
    table = VersionedTable.create(spark.range(5).limit(0), str(tmp_path / "e"))
    assert table.read().isEmpty() and table.commit(spark.range(3)) == 1 and table.read().count() == 3


def test_stock_and_deletes_tell_what_differs(spark, shop):
    deltas = spark.createDataFrame([(1, -1), (2, -100000)], "nomenclature_id bigint, delta bigint")
    applied = changes.apply_stock(shop.nomenclature, deltas)
    quantity = dict(tuples(applied.table, "id", "quantity"))
    assert tuples(applied.changed, "id", "quantity") == [(1, quantity[1])]
    deleted = changes.guarded_delete("clients", shop, shop.clients.select("id"))
    left = {i for (i,) in tuples(deleted.table, "id")}
    assert {i for (i,) in tuples(deleted.gone, "id")} == {i for (i,) in tuples(shop.clients, "id")} - left


def test_deleting_orders_rewrites_their_files_only(spark, shop, make, tmp_path):
    lines = [(n, n // 10 + 1, 1, 1, 1, 2) for n in range(2000)]
    items = make("order_items", "id, order_id, nomenclature_id, quantity, price, total_price", lines)
    made = make("orders", "id, client_id, total_amount, status", [(n, 1, 20, "pending") for n in range(1, 201)])
    orders_ = VersionedTable.create(made, str(tmp_path / "orders"), file_rows=5)
    lines_ = VersionedTable.create(items, str(tmp_path / "items"), key="order_id", file_rows=50)
    before, lines_before = names(orders_), names(lines_)
    assert len(before) >= 40 and len(lines_before) >= 40
    t = shop.with_(orders=orders_.read(), order_items=lines_.read())
    deleted = orders.delete_orders(t, spark.createDataFrame([(17,), (120,), (999,)], "id bigint"))
    orders_.commit(gone=deleted.gone)
    lines_.commit(gone=deleted.gone.withColumnRenamed("id", "order_id"))
    assert sorted(tuples(orders_.read(), "id")) == sorted(tuples(deleted.orders, "id"))
    assert sorted(tuples(lines_.read(), "id")) == sorted(tuples(deleted.order_items, "id"))
    assert len(before - names(orders_)) == 2 and 2 <= len(lines_before - names(lines_)) <= 4
    assert tuples(deleted.restocked, "id") == [(1,)]


def test_changed_totals_alone(spark, shop, make, tmp_path):
    made = make("orders", "id, client_id, total_amount", [(1, 1, 20), (2, 1, 21), (3, 1, None), (4, 1, 5), (5, 1, 7)])
    items = make("order_items", "order_id, nomenclature_id, quantity, price, total_price", [(n, 1, 1, 20, 20) for n in (1, 2, 3)])
    assert sorted(tuples(changes.total_changes(made, items), "id", "total_amount")) == [(2, 20), (3, 20)]
    touched = spark.createDataFrame([(1,), (4,), (4,)], "id bigint")
    assert tuples(changes.total_changes(made, items, touched), "id", "total_amount") == [(4, 0)]
    table = VersionedTable.create(made, str(tmp_path / "orders"))
    table.commit(changes.total_changes(table.read(), items))
    assert sorted(tuples(table.read(), "id", "total_amount")) == sorted(tuples(changes.order_totals(made, items), "id", "total_amount"))


def test_a_key_of_many_rows_spreads(spark, tmp_path):
    # Few rows as they are, Spark would merge the ranges.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(6000).selectExpr("id AS line", "IF(id % 3 = 0, id, 1L) AS order_id")
    table = VersionedTable.create(rows, str(tmp_path / "hot"), key="order_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert table.read().where("order_id = 1").selectExpr("count(DISTINCT _metadata.file_name) AS n").first().n > 1
    table.commit(spark.createDataFrame([(-1, 1)], "line bigint, order_id bigint"))
    assert tuples(table.read().where("order_id = 1")) == [(-1, 1)]
    assert table.read().count() == 2001


def test_changes_take_the_stored_types(spark, tmp_path):
    rows = spark.range(3).selectExpr("id", "CAST(id AS DECIMAL(12,2)) AS amount")
    table = VersionedTable.create(rows, str(tmp_path / "typed"))
    table.commit(spark.range(1, 2).selectExpr("id", "CAST(7.5 AS DECIMAL(20,2)) AS amount"))
    assert [float(a) for (a,) in sorted(tuples(table.read(), "amount"))] == [0, 2, 7.5]
    with pytest.raises(Exception, match="(?i)overflow|cannot be represented"):
        table.commit(spark.range(1, 2).selectExpr("id", "CAST(1e15 AS DECIMAL(20,2)) AS amount"))
    assert table.versions() == [0, 1]
