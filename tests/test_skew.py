"""One key holds a third of all rows: hot joins must be split and results stay whole."""

from __future__ import annotations

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from orderlytics.operators import reports, search
from orderlytics.session import cut_lineage
from orderlytics.sources.star import star_tables

FOLDER = "/root/testdata/sf0.01"

# Large tables and large partitions, scaled down to the test data.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4kb",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4kb",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(scope="module")
def tables(spark):
    t = star_tables(spark, FOLDER)
    third = F.crc32(F.concat_ws("/", "order_id", *t.item_key).cast("binary")) % 3 == 0

    def hot(column, value):
        skewed = F.when(third, F.lit(value)).otherwise(F.col(column)).cast("bigint")
        # Several files, so that a hot shuffle partition has several writers.
        return cut_lineage(t.order_items.withColumn(column, skewed).repartition(8), "hot-items")

    orders = t.orders.withColumn("client_id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("client_id")))
    return {
        "order": t.with_(order_items=hot("order_id", 42)),
        "product": t.with_(order_items=hot("nomenclature_id", 7)),
        "client": t.with_(orders=cut_lineage(orders.repartition(8), "hot-orders")),
    }


@pytest.fixture
def large_scale(spark):
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize(
    ("hot", "report"),
    [
        ("order", reports.top_products),
        ("order", reports.product_stats),
        ("product", reports.order_details),
        ("client", lambda t: search.order_search(t, number=None)),
        ("client", reports.order_summary),
    ],
)
def test_hot_joins_are_split(spark, tables, large_scale, hot, report):
    df = report(tables[hot])
    df.collect()
    assert "skew=true" in final_plan(df)


@pytest.mark.parametrize("hot", ["order", "product", "client"])
def test_client_totals_join_single_rows(spark, tables, large_scale, hot):
    """Items are one row per order before they meet an order: nothing is left to split."""
    df = reports.client_order_summary(tables[hot])
    total = sum(r.total_amount for r in df.collect())
    live = tables[hot].orders.where("status <> 'cancelled'").select(F.col("id").alias("order_id"), "client_id")
    active = tables[hot].clients.where("is_active").select(F.col("id").alias("client_id"))
    plain = tables[hot].order_items.join(live, "order_id").join(active, "client_id")
    assert total == pytest.approx(float(plain.agg(F.sum("total_price")).first()[0]), rel=1e-12)


def test_hot_order_has_the_grain_of_any_other(spark, tables, large_scale):
    t = tables["order"]
    items = t.order_items.where("order_id = 42")
    names = dict(tuples(t.nomenclature, "id", "name"))
    ordered = [names[r.nomenclature_id] for r in items.orderBy(*t.item_key).collect()]
    assert len(ordered) > 15_000
    [details] = reports.order_details(t).where("order_id = 42").collect()
    assert (details.items_count, details.products) == (len(ordered), ", ".join(ordered))
    lines = sorted(tuples(reports.order_lines(t).where("order_id = 42"), "position", "product_name"))
    assert lines == list(enumerate(ordered))
    full = search.order_with_items(t).where("id = 42").select("items_count", "position", "item.nomenclature_name")
    assert sorted(map(tuple, full.collect())) == [(len(ordered), n, name) for n, name in enumerate(ordered)]
