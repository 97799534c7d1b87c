from __future__ import annotations

from datetime import datetime

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from orderlytics.schemas import SCHEMAS
from orderlytics.session import cut_lineage, drop_scratch, scratch_path, scratch_root
from orderlytics.sources.star import star_tables
from orderlytics.sources.tables import load, with_defaults, write, write_orders_by_month

SMALL = "/root/testdata/sf0.001"


def test_write_and_load(spark, shop):
    folder = scratch_path(spark, "shop")
    for name in SCHEMAS:
        write(getattr(shop, name).select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]]), f"{folder}/{name}")
    back = load(spark, folder)
    for name, schema in SCHEMAS.items():
        df = getattr(back, name)
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]
        assert df.count() == getattr(shop, name).count()
    narrow = shop.orders.withColumn("total_amount", F.col("total_amount").cast("decimal(12,2)"))
    write(narrow, f"{folder}/orders", "append")
    assert tuples(load(spark, folder).orders.agg(F.sum("total_amount"))) == [(2 * 595000,)]
    write(back.clients, f"{folder}/clients", "append")
    assert load(spark, folder).clients.count() == 10


def test_versions_are_never_overwritten(spark, shop):
    path = scratch_path(spark, "version")
    write(shop.clients, path)
    with pytest.raises(Exception, match="already exists"):
        write(shop.clients, path)
    with pytest.raises(ValueError):
        write(shop.clients, path, "overwrite")


def test_months_prune(spark, shop):
    path = scratch_path(spark, "months")
    write_orders_by_month(shop.orders, path)
    read = spark.read.parquet(path).where("order_month = '2024-01'")
    assert read.count() == 5
    assert "PartitionFilters: [isnotnull(order_month" in read._jdf.queryExecution().toString()


def test_defaults(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "y", "paid")], "client_id bigint, order_number string, payment_status string")
    filled = with_defaults(rows, "orders", F.lit("2024-02-02").cast("timestamp"), "me")
    first, second = sorted(filled.collect(), key=lambda r: r.client_id)
    assert (first.status, first.payment_status, first.total_amount, first.created_by) == ("pending", "unpaid", 0, "me")
    assert first.created_at == datetime(2024, 2, 2) and first.updated_by is None
    assert second.payment_status == "paid"
    assert len(first.uuid) == 36 and first.uuid != second.uuid


def test_scratch_folder(spark):
    assert scratch_path(spark, "x").startswith(scratch_root(spark))
    df = cut_lineage(spark.range(10), "range")
    assert df.count() == 10
    drop_scratch(spark, df.inputFiles()[0].rsplit("/", 1)[0])
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0])


def test_seed_shapes(raw_seed):
    assert [getattr(raw_seed, n).count() for n in SCHEMAS] == [11, 8, 5, 5, 13]
    for name, schema in SCHEMAS.items():
        assert [(f.name, f.dataType) for f in getattr(raw_seed, name).schema] == [(f.name, f.dataType) for f in schema]


def test_star_item_key_is_unique(spark):
    t = star_tables(spark, SMALL)
    items = t.order_items
    assert items.select("order_id", *t.item_key).distinct().count() == items.count()
    assert {s for (s,) in tuples(t.orders.select("status").distinct())} == {"pending", "processing", "completed", "cancelled", "refunded"}
