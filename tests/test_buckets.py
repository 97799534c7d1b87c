from __future__ import annotations

import re
import uuid

import pytest
from helpers import tuples

from orderlytics.operators import changes, reports
from orderlytics.sources import buckets
from orderlytics.sources.star import star_tables

SMALL = "/root/testdata/sf0.001"
REPORTS = [
    reports.client_order_summary,
    reports.client_stats,
    reports.sales_by_month,
    reports.product_stats,
    reports.category_effectiveness,
    reports.order_summary,
    reports.order_stats,
    reports.status_stats,
]


@pytest.fixture(scope="module")
def star(spark):
    return star_tables(spark, SMALL)


@pytest.fixture(scope="module")
def stored(spark, star, tmp_path_factory):
    folder = f"{tmp_path_factory.mktemp('shop')}/{uuid.uuid4().hex}"
    return folder, buckets.write(star, folder, bucket_rows=1_500)


@pytest.fixture
def no_broadcast(spark):
    """Joins as between large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(df):
    """Columns by which the plan shuffles."""
    return {re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan(df))}


def test_buckets_follow_the_rows(stored):
    counts = stored[1].buckets
    assert counts["orders"] == counts["order_items"] == 4
    assert counts["clients"] == counts["clients_email"] == 1


@pytest.mark.parametrize("report", REPORTS, ids=lambda r: r.__name__)
def test_reports_equal(star, stored, report):
    assert sorted(map(str, report(stored[1].tables).collect())) == sorted(map(str, report(star).collect()))


@pytest.mark.parametrize("report", [reports.client_order_summary, reports.sales_by_month, reports.order_summary])
def test_items_and_orders_are_not_shuffled(star, stored, no_broadcast, report):
    plain, laid_out = exchanged(report(star)), exchanged(report(stored[1].tables))
    assert {"order_id", "id"} & plain
    assert "order_id" not in laid_out
    # Clients meet sums per client by the client's id; orders meet items where they lie.
    assert not any(k in laid_out for k in ("order_id", "id")), laid_out


def test_order_totals_are_not_shuffled(stored, no_broadcast):
    t = stored[1].tables
    assert exchanged(changes.order_totals(t.orders, t.order_items)) == set()


def test_a_key_reads_one_bucket(stored):
    wanted = reports.item_totals(stored[1].tables.order_items.where("order_id = 7"))
    assert "SelectedBucketsCount: 1 out of 4" in plan(wanted)


def test_a_batch_meets_the_index_where_it_lies(spark, star, stored, no_broadcast):
    t = stored[1].tables
    batch = spark.createDataFrame(
        [(1, "A", "c1@example.com"), (2, "B", "new@example.com"), (3, "C", None), (4, "D", "new@example.com")],
        "seq bigint, name string, email string",
    )
    checked = changes._with_holders(batch, "clients", t)
    assert exchanged(checked) == {"_wanted"}, "only the batch moves"
    ours = changes.insert_batch("clients", t, batch)
    plain = changes.insert_batch("clients", star, batch)
    expected = sorted(tuples(plain.rejected, "seq", "reason"))
    assert sorted(tuples(ours.rejected, "seq", "reason")) == expected == [(1, "email_taken"), (4, "email_taken")]
    assert sorted(tuples(ours.changed, "id", "name")) == sorted(tuples(plain.changed, "id", "name"))


def test_a_replaced_table_loses_its_index(stored):
    t = stored[1].tables
    assert set(t.unique) == {"clients", "nomenclature", "orders"}
    assert set(t.with_(clients=t.clients.limit(1)).unique) == {"nomenclature", "orders"}


def test_a_later_session_opens_the_folder(spark, stored):
    folder, shop = stored
    before = sorted(tuples(shop.tables.orders))
    buckets.forget(spark, folder)
    again = buckets.open_shop(spark, folder, shop.tables.item_key)
    assert again.buckets == shop.buckets
    assert sorted(tuples(again.tables.orders)) == before
    assert exchanged(reports.item_totals(again.tables.order_items)) == set()


def test_heavy_keys_lie_apart(spark, star, tmp_path):
    # A third of all items belong to one order, and many orders have more than five.
    hot = star.order_items.selectExpr("* EXCEPT (order_id)", "IF(l_linenumber <= 2, 1L, order_id) AS order_id")
    t = star.with_(order_items=hot.select(star.order_items.columns))
    shop = buckets.write(t, str(tmp_path / "hot"), bucket_rows=1_500, heavy_rows=5)
    largest = spark.read.parquet(str(tmp_path / "hot" / "order_items-light")).groupBy("order_id").count()
    assert largest.agg({"count": "max"}).first()[0] <= 5
    assert sorted(tuples(shop.tables.order_items.select(hot.columns))) == sorted(tuples(hot))
    for report in (reports.client_order_summary, reports.product_stats):
        assert sorted(map(str, report(shop.tables).collect())) == sorted(map(str, report(t).collect()))


def test_rows_without_key_and_empty_tables(spark, empty, make, tmp_path):
    shop = buckets.write(empty, str(tmp_path / "none"))
    assert reports.client_order_summary(shop.tables).count() == 0
    nameless = make("order_items", "id, order_id, nomenclature_id, quantity, price", [(n, None, 1, 1, 1) for n in range(9)])
    t = empty.with_(order_items=nameless)
    for n, heavy in enumerate((5, 50)):
        shop = buckets.write(t, str(tmp_path / f"nameless{n}"), heavy_rows=heavy)
        assert shop.tables.order_items.count() == 9


def test_a_folder_is_written_once(star, stored):
    with pytest.raises(Exception, match="(?i)already exists"):
        buckets.write(star, stored[0])
