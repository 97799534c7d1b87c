"""All operators as named queries `(spark, folder) -> DataFrame`."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.functions.measures import as_double
from orderlytics.operators import changes, hierarchy, intake, integrity, orders, pages, reports, search, subtrees
from orderlytics.plans import batches
from orderlytics.session import scratch_path, tune
from orderlytics.sources import buckets, star
from orderlytics.sources.tables import Tables, with_defaults, write_orders_by_month
from orderlytics.sources.versions import VersionedTable
from orderlytics.streaming import metrics, sums
from orderlytics.streaming import orders as feeds
from orderlytics.streaming.state import ArrivalLog, current_state, finish, keep_new, keep_updates

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(tune(spark), folder)

    QUERIES[build.__name__] = run
    return build


def over_tables(name: str, build: Callable[[Tables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: build(star.star_tables(tune(spark), folder))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    """Integer columns with gaps as doubles: engines disagree on how to hand over NULL integers."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def money_to_double(df: DataFrame) -> DataFrame:
    exact = [f.name for f in df.schema.fields if f.dataType.typeName() == "decimal"]
    return df.withColumns({c: as_double(F.col(c)) for c in exact}) if exact else df


# --- sources -----------------------------------------------------------------


@query
def table_scan(spark: SparkSession, folder: str) -> DataFrame:
    t = star.star_tables(spark, folder)

    def profile(name: str, df: DataFrame, key: str) -> DataFrame:
        return df.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.sum(key).alias("key_sum")
        )

    return union(
        profile("categories", t.categories, "id"),
        profile("nomenclature", t.nomenclature, "id"),
        profile("clients", t.clients, "id"),
        profile("orders", t.orders, "id"),
        profile("order_items", t.order_items, "order_id"),
    )


@query
def partitioned_write(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "orders-by-month")
    write_orders_by_month(star.star_tables(spark, folder).orders, path)
    months = spark.read.parquet(path).groupBy(F.col("order_month").cast("string").alias("order_month"))
    return months.agg(F.count(F.lit(1)).alias("row_count"), as_double(F.sum("total_amount")).alias("amount"))


@query
def insert_defaults(spark: SparkSession, folder: str) -> DataFrame:
    orders = star.star_tables(spark, folder).orders
    keep = {"status": "pending", "payment_status": "unpaid"}
    sparse = orders.select("id", "client_id", *[F.nullif(F.col(c), F.lit(v)).alias(c) for c, v in keep.items()])
    filled = with_defaults(sparse, "orders")
    return filled.select(
        "id",
        "client_id",
        as_double(F.col("total_amount")).alias("total_amount"),
        "status",
        "payment_status",
        "created_by",
        (F.col("uuid").isNotNull() & F.col("created_at").isNotNull()).alias("stamped"),
    )


# --- reports -----------------------------------------------------------------

over_tables("client_order_summary", reports.client_order_summary)
over_tables("category_children_count", reports.category_children_count)
over_tables("top_clients", reports.top_clients)
over_tables("top_clients_any", lambda t: reports.top_clients(t, require_active=False))
over_tables("category_stats", reports.category_stats)
over_tables("category_stats_nulls", lambda t: doubles(reports.category_stats(t, zero_fill=False), "total_quantity"))
over_tables("sales_by_month", reports.sales_by_month)
over_tables("top_products", reports.top_products)
over_tables("top_products_any", lambda t: reports.top_products(t, require_active=False))
over_tables("category_effectiveness", reports.category_effectiveness)
over_tables(
    "category_effectiveness_strict",
    lambda t: reports.category_effectiveness(t, exclude_cancelled_items=True, distinct_products=True),
)
over_tables("order_details", reports.order_details)
over_tables("order_lines", reports.order_lines)
over_tables("status_stats", reports.status_stats)
over_tables("seasonality", reports.seasonality)
over_tables("order_stats", reports.order_stats)
over_tables("client_stats", reports.client_stats)
over_tables("product_stats", reports.product_stats)
over_tables("product_stats_live", lambda t: reports.product_stats(t, exclude_cancelled_items=True))
over_tables("client_point_stats", reports.client_point_stats)
over_tables("order_summary", reports.order_summary)

# --- hierarchy ---------------------------------------------------------------

over_tables("category_hierarchy", lambda t: doubles(hierarchy.category_hierarchy(t.categories), "parent_id"))
over_tables(
    "category_closure",
    lambda t: doubles(
        hierarchy.category_closure(t.categories).withColumn("path_array", hierarchy.dotted()), "parent_id"
    ),
)
over_tables("category_path", lambda t: hierarchy.category_path(t.categories))
over_tables("category_display", lambda t: hierarchy.category_display(t.categories))
over_tables("three_level_names", lambda t: hierarchy.three_level_names(t.categories))
over_tables("descendants", lambda t: hierarchy.descendants(t.categories))


@query
def descendants_broken(spark: SparkSession, folder: str) -> DataFrame:
    """What lies below the upper two levels of a tree with a cycle and a missing parent."""
    broken = batches.broken_categories(spark, folder, star.star_tables(spark, folder))
    return hierarchy.descendants(broken, broken.where("level < 2"))


@query
def subtree_index(spark: SparkSession, folder: str) -> DataFrame:
    """Below every node of a tree with a cycle and a missing parent, by intervals."""
    broken = batches.broken_categories(spark, folder, star.star_tables(spark, folder))
    index = subtrees.SubtreeIndex.build(broken, scratch_path(spark, "subtree-index"))
    return index.below(broken).where("distance > 0")


@query
def category_tree(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy.category_tree(star.star_tables(spark, folder).categories)
    flat = tree.select("id", "name", "parent_id", "level", "path", "position", F.col("child.id").alias("child_id"))
    return doubles(flat, "parent_id", "position", "child_id")


@query
def unreachable_nodes(spark: SparkSession, folder: str) -> DataFrame:
    broken = batches.broken_categories(spark, folder, star.star_tables(spark, folder))
    return doubles(hierarchy.unreachable_nodes(broken).select("id", "name", "parent_id", "level"), "parent_id")


# --- search ------------------------------------------------------------------

over_tables("client_search", lambda t: search.client_search(t, query="R#%1_9", number=None))
over_tables("client_search_page", lambda t: search.client_search(t, query="C1", number=2, size=25))
over_tables(
    "product_search",
    lambda t: money_to_double(
        search.product_search(t, query="Ring", min_price=910, max_price=1050, in_stock=True, number=None)
    ),
)
over_tables(
    "order_search",
    lambda t: money_to_double(
        search.order_search(
            t,
            status="completed",
            date_from=datetime(1996, 1, 1),
            date_to=datetime(1999, 12, 31),
            min_amount=1000,
            max_amount=250000,
            number=None,
        )
    ),
)
over_tables(
    "order_search_page", lambda t: money_to_double(search.order_search(t, payment_status="unpaid", number=3, size=50))
)
over_tables(
    "category_list", lambda t: doubles(search.category_list(t, is_active=True, number=None), "parent_id")
)
over_tables(
    "category_by_ids",
    lambda t: doubles(search.category_by_ids(t, t.categories.selectExpr("parent_id AS id")), "parent_id"),
)
over_tables("client_by_ids", lambda t: search.client_by_ids(t, t.orders.selectExpr("client_id AS id")))
over_tables(
    "product_by_ids",
    lambda t: money_to_double(search.product_by_ids(t, t.order_items.selectExpr("nomenclature_id AS id"))),
)
over_tables("order_items_count", lambda t: search.order_items_count(t, t.order_items.selectExpr("order_id AS id")))
over_tables("page", lambda t: money_to_double(search.page(t.orders, [F.desc("order_date"), "id"], 7, 100)))
over_tables(
    "page_deep", lambda t: money_to_double(search.page(t.orders, [F.desc("order_date"), "id"], 9, 100, top_rows=0))
)
over_tables("page_after", lambda t: money_to_double(search.page_after(t.orders, "id", 777, 100)))


@query
def page_index(spark: SparkSession, folder: str) -> DataFrame:
    """The second page by number and the one that follows its last row, from an index over all clients."""
    t = star.star_tables(spark, folder)
    listed = t.clients.select("name", "id", "address")
    index = pages.PageIndex.build(listed, ["name", "id"], scratch_path(spark, "page-index"), file_rows=1_000)
    second = index.page(2, 40)
    last = second.orderBy(F.desc("name"), F.desc("id")).first()
    return second if last is None else second.unionByName(index.page_after((last["name"], last["id"]), 40))


over_tables("page_totals", lambda t: search.page_totals(t.orders, 20))


@query
def order_with_items(spark: SparkSession, folder: str) -> DataFrame:
    t = star.star_tables(spark, folder)
    header = ["id", "client_id", "order_number", "status", "client_name", "items_count"]
    flat = search.order_with_items(t).select(*header, "position", "item", "item.nomenclature_id", "item.quantity")
    return doubles(flat, "position", "nomenclature_id", "quantity").select(
        *header,
        "position",
        "nomenclature_id",
        "quantity",
        as_double(F.col("item.price")).alias("price"),
        as_double(F.col("item.total_price")).alias("total_price"),
        "item.nomenclature_name",
        "item.nomenclature_sku",
    )


# --- integrity ---------------------------------------------------------------


@query
def record_rules(spark: SparkSession, folder: str) -> DataFrame:
    t = star.star_tables(spark, folder)

    def broken(df: DataFrame, table: str) -> DataFrame:
        codes = df.select(F.col("id"), F.explode(integrity.VIOLATIONS).alias("code"))
        return codes.select(F.lit(table).alias("table_name"), "id", "code")

    return union(
        broken(integrity.record_rules(batches.raw_clients(spark, folder), "clients"), "clients"),
        broken(integrity.record_rules(batches.raw_products(spark, folder), "nomenclature"), "nomenclature"),
        broken(integrity.record_rules(batches.raw_categories(spark, folder), "categories"), "categories"),
        broken(integrity.order_rules(batches.raw_orders(t), batches.raw_items(t)), "orders"),
    )


@query
def storage_rules(spark: SparkSession, folder: str) -> DataFrame:
    t = star.star_tables(spark, folder)

    def counts(df: DataFrame, table: str) -> DataFrame:
        codes = integrity.record_rules(df, table, "storage").select(F.explode(integrity.VIOLATIONS).alias("code"))
        return codes.groupBy("code").agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(table))

    return union(
        counts(batches.raw_clients(spark, folder), "clients"),
        counts(batches.raw_products(spark, folder), "nomenclature"),
        counts(batches.raw_categories(spark, folder), "categories"),
        counts(batches.raw_orders(t), "orders"),
        counts(batches.raw_items(t), "order_items"),
    )


over_tables("fk_violations", lambda t: integrity.fk_violations(t, require_active=True))
over_tables("unique_violations", integrity.unique_violations)


def _each_table(t: Tables, check: Callable[[str], DataFrame]) -> DataFrame:
    """Refused rows of all tables, items under the id of their order."""
    keys = {"categories": "id", "nomenclature": "id", "clients": "id", "orders": "id", "order_items": "order_id"}
    return union(
        *[check(table).select(F.lit(table).alias("table_name"), F.col(key).alias("id"), "reason") for table, key in keys.items()]
    )


over_tables("fk_rejected", lambda t: _each_table(t, lambda table: integrity.fk_rejected(t, table, require_active=True)))


@query
def unique_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """All tables, with categories that have a sibling of their name."""
    t = star.star_tables(spark, folder)
    t = t.with_(categories=batches.twin_categories(t))
    return _each_table(t, lambda table: integrity.unique_rejected(t, table))


over_tables("total_mismatch", integrity.order_total_mismatch)
over_tables("total_mismatch_items", integrity.item_total_mismatch)

# --- changes -----------------------------------------------------------------


@query
def order_intake(spark: SparkSession, folder: str) -> DataFrame:
    t = star.star_tables(spark, folder)
    stock = t.nomenclature.withColumn("quantity", F.col("quantity") * 10)
    decided = intake.order_intake(t.orders, batches.intake_items(t), t.clients, stock, ["order_date", "id"], t.item_key)
    return doubles(decided, "nomenclature_id")


@query
def apply_stock(spark: SparkSession, folder: str) -> DataFrame:
    """Take out the orders in processing, give back the cancelled and refunded ones."""
    t = star.star_tables(spark, folder)
    sold = changes.order_stock_deltas(t.order_items, t.orders.where("status = 'processing'"), -1)
    returned = changes.order_stock_deltas(t.order_items, t.orders.where("status IN ('cancelled', 'refunded')"), 1)
    applied = changes.apply_stock(t.nomenclature, sold.unionByName(returned))
    kept = applied.table.select("id", "quantity")
    refused = applied.rejected.select("id", "reason")
    return kept.join(refused, "id", "left")


@query
def assign_order_numbers(spark: SparkSession, folder: str) -> DataFrame:
    t = star.star_tables(spark, folder)
    numbered = changes.assign_order_numbers(t.orders, batches.unnumbered_orders(t), ["order_date", "id"])
    return numbered.select("id", "order_number")


over_tables(
    "order_totals",
    lambda t: changes.order_totals(t.orders, t.order_items).select(
        "id", as_double(F.col("total_amount")).alias("total_amount")
    ),
)
over_tables(
    "order_totals_changed",
    lambda t: changes.order_totals(t.orders, t.order_items, t.orders.where("status = 'pending'")).select(
        "id", as_double(F.col("total_amount")).alias("total_amount")
    ),
)


def _with_paths(t: Tables) -> Tables:
    paths = hierarchy.category_path(t.categories).select("id", "path")
    return t.with_(categories=t.categories.join(paths, "id"))


def _patched(table: str, build: Callable[[SparkSession, str], DataFrame], *links: str) -> None:
    """Two queries: the patched table and the refused patches."""

    def apply(spark: SparkSession, folder: str) -> changes.Applied:
        t = star.star_tables(tune(spark), folder)
        return changes.patch_apply(table, _with_paths(t) if table == "categories" else t, build(spark, folder))

    QUERIES[f"patch_apply_{table}"] = lambda spark, folder: money_to_double(
        doubles(apply(spark, folder).table, *links)
    )
    QUERIES[f"patch_apply_{table}_rejected"] = lambda spark, folder: apply(spark, folder).rejected.select(
        "seq", "id", "reason"
    )


_patched("clients", batches.client_patches)
_patched("nomenclature", batches.product_patches)
_patched("categories", batches.category_patches, "parent_id")
_patched("orders", batches.order_patches)


@query
def versioned_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The clients after a version with patched rows and one without the inactive."""
    t = star.star_tables(spark, folder)
    stored = VersionedTable.create(t.clients, scratch_path(spark, "clients"), file_rows=1_000)
    patches = batches.client_patches(spark, folder)
    stored.commit(changes.patch_apply("clients", t.with_(clients=stored.read()), patches).changed)
    stored.commit(gone=stored.read().where("NOT is_active"))
    return doubles(stored.read())


@query
def versioned_order_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and items after a version without the refunded orders and one with the totals of the others."""
    t = star.star_tables(spark, folder)
    stored = VersionedTable.create(t.orders, scratch_path(spark, "orders"), file_rows=10_000)
    items = VersionedTable.create(t.order_items, scratch_path(spark, "items"), key="order_id", file_rows=10_000)
    t = t.with_(orders=stored.read(), order_items=items.read())
    gone = changes.cascade_delete(t, t.orders.where("status = 'refunded'")).gone
    stored.commit(gone=gone)
    items.commit(gone=gone.withColumnRenamed("id", "order_id"))
    stored.commit(changes.total_changes(stored.read(), items.read()))
    counts = items.read().groupBy(F.col("order_id").alias("id")).agg(F.count(F.lit(1)).alias("items_count"))
    orders = stored.read().join(counts, "id", "left")
    items_count = F.coalesce("items_count", F.lit(0)).alias("items_count")
    return orders.select("id", "status", as_double(F.col("total_amount")).alias("total_amount"), items_count)


def _in_buckets(spark: SparkSession, folder: str) -> Tables:
    path = scratch_path(spark, "shop")
    return buckets.write(star.star_tables(spark, folder), path, bucket_rows=100_000).tables


@query
def bucketed_order_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of all orders, from a shop whose items lie with their orders."""
    return reports.order_summary(_in_buckets(spark, folder))


@query
def guarded_delete(spark: SparkSession, folder: str) -> DataFrame:
    t = star.star_tables(spark, folder)

    def outcome(table: str) -> DataFrame:
        rows = getattr(t, table)
        applied = changes.guarded_delete(table, t, batches.with_unknown(rows.select("id")))
        refused = applied.rejected.select(F.lit(table).alias("table_name"), "id", "reason")
        kept = applied.table.select(F.lit(table).alias("table_name"), "id", F.lit("remains").alias("reason"))
        return refused.unionByName(kept)

    return union(*[outcome(table) for table in ("categories", "clients", "nomenclature", "orders")])


@query
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Delete every order that may be deleted; what remains, and the stock handed back."""
    t = star.star_tables(spark, folder)
    done = changes.cascade_delete(t, t.orders.where("status IN ('pending', 'cancelled', 'refunded')"))

    def tagged(df: DataFrame, kind: str, key: str, value: F.Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), value.cast("bigint").alias("value"))

    items = done.order_items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    return union(
        tagged(done.orders, "order", "id", F.lit(1)),
        tagged(items, "items", "order_id", F.col("n")),
        tagged(done.stock_deltas, "stock", "nomenclature_id", F.col("delta")),
    )


@query
def delete_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Ask for every order and as many unknown ones; what remains, the stock, and the refusals."""
    t = star.star_tables(spark, folder)
    return _orders_changed(orders.delete_orders(t, batches.with_unknown(t.orders.select("id"))))


@query
def create_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The intake batch on top of stored orders without items, whose numbers it continues; some ids and numbers are taken."""
    t = star.star_tables(spark, folder)
    stored = t.orders.withColumn("id", F.col("id") + batches.UNKNOWN_ID_OFFSET)
    stock = t.nomenclature.withColumn("quantity", F.col("quantity") * 10)
    shop = t.with_(orders=stored, order_items=t.order_items.where("false"), nomenclature=stock)
    return _orders_changed(orders.create_orders(shop, batches.offered_orders(t), batches.intake_items(t), ["order_date", "id"]))


def _orders_changed(done: orders.OrdersChanged) -> DataFrame:
    def told(df: DataFrame, kind: str, key: str, value: F.Column, text: F.Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), value.cast("double").alias("value"), text.alias("label"))

    none = F.lit(None).cast("string")
    items = done.order_items.groupBy("order_id").agg(F.sum("total_price").alias("total"))
    return union(
        told(done.orders, "order", "id", F.col("total_amount"), F.col("order_number")),
        told(items, "items", "order_id", F.col("total"), none),
        told(done.nomenclature, "stock", "id", F.col("quantity"), none),
        told(done.rejected, "refused", "id", F.lit(None), F.col("reason")),
    )


def _subtrees(t: Tables, ids: DataFrame, index: subtrees.SubtreeIndex | None = None) -> DataFrame:
    done = changes.delete_subtree(t, ids, index)
    kept = done.table.select("id", "name", F.lit("remains").alias("reason"))
    return kept.unionByName(done.rejected.select("id", F.lit("").alias("name"), "reason"))


@query
def delete_subtree(spark: SparkSession, folder: str) -> DataFrame:
    """Delete inactive categories; the products of one of them are gone already."""
    t = star.star_tables(spark, folder)
    return _subtrees(t.with_(nomenclature=t.nomenclature.where("category_id <> 107")), t.categories.where("NOT is_active"))


@query
def delete_subtree_broken(spark: SparkSession, folder: str) -> DataFrame:
    """Delete the upper two levels of a tree with a cycle and a missing parent; region 1 has no products."""
    t = star.star_tables(spark, folder)
    region = t.categories.where("parent_id = 1").select(F.col("id").alias("category_id"))
    broken = batches.broken_categories(spark, folder, t)
    t = t.with_(categories=broken, nomenclature=t.nomenclature.join(region, "category_id", "left_anti"))
    return _subtrees(t, broken.where("level < 2"))


@query
def delete_subtree_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Delete inactive categories, found as intervals; the products of one of them are gone already."""
    t = star.star_tables(spark, folder)
    index = subtrees.SubtreeIndex.build(t.categories, scratch_path(spark, "subtree-index"))
    t = t.with_(nomenclature=t.nomenclature.where("category_id <> 107"))
    return _subtrees(t, t.categories.where("NOT is_active"), index)


def _inserted(
    table: str,
    build: Callable[[SparkSession, str], DataFrame],
    shown: str,
    stored: Callable[[SparkSession, str], Tables] = star.star_tables,
) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = stored(tune(spark), folder)
        t = _with_paths(t) if table == "categories" else t
        applied = changes.insert_batch(table, t, build(spark, folder))
        new = applied.table.join(getattr(t, table).select("id"), "id", "left_anti")
        added = new.select(
            F.lit("added").alias("outcome"),
            F.col("id").alias("key"),
            F.expr(shown).cast("string").alias("value"),
            "is_active",
        )
        refused = applied.rejected.select(
            F.lit("rejected").alias("outcome"),
            F.col("seq").alias("key"),
            F.col("reason").alias("value"),
            F.lit(False).alias("is_active"),
        )
        return added.unionByName(refused)

    return run


QUERIES["insert_batch_clients"] = _inserted("clients", batches.new_clients, "email")
QUERIES["insert_batch_products"] = _inserted("nomenclature", batches.new_products, "sku")


@query
def inserts_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """New products between patches that switch their categories: which are refused, and why."""
    t = star.star_tables(spark, folder)
    switches = changes.category_switches(t, batches.switched_categories(spark, folder))
    arriving = batches.new_products(spark, folder).withColumn("seq", F.col("seq") * 2)
    return changes.insert_batch("nomenclature", t, arriving, switches=switches).rejected.select("seq", "reason")


QUERIES["insert_batch_indexed"] = _inserted("nomenclature", batches.new_products, "sku", _in_buckets)
QUERIES["insert_batch_categories"] = _inserted(
    "categories", batches.new_categories, "path || ' ' || level"
)

# --- metrics and streams -------------------------------------------------------


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return star.scan(spark, folder, "events")


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    events = star.scan_stream(spark, folder, "events")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Work off a stream and return the latest row of every key."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream-state")
    finish(keep_updates(stream, path, keys))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    return current_state(spark, path, schema, keys)


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query
def event_counters(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.event_counters(_events(spark, folder), ["event_type"])


@query
def event_counters_stream(spark: SparkSession, folder: str) -> DataFrame:
    stream = metrics.event_counters(_event_stream(spark, folder), ["event_type"], "1 hour", "1 hour")
    return _ntz(_run(stream, ["window_start", "event_type"]), "window_start")


def _exact(events: DataFrame) -> DataFrame:
    return events.withColumn("exact", F.col("value").cast("decimal(18,6)"))


@query
def latency_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.latency_histogram(_exact(_events(spark, folder)), ["event_type"], summed="exact")


@query
def latency_histogram_stream(spark: SparkSession, folder: str) -> DataFrame:
    events = _exact(_event_stream(spark, folder))
    stream = metrics.latency_histogram(
        events, ["event_type"], buckets=(1.0, 10.0, 100.0), width="1 day", lateness="1 hour", summed="exact"
    )
    return _ntz(_run(stream, ["window_start", "event_type", "le"]), "window_start")


@query
def error_and_request_rate(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.error_and_request_rate(_events(spark, folder))


@query
def error_and_request_rate_stream(spark: SparkSession, folder: str) -> DataFrame:
    stream = metrics.error_and_request_rate(_event_stream(spark, folder), width="1 day", lateness="1 hour")
    return _ntz(_run(stream, ["window_start"]), "window_start")


@query
def event_counters_late(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counters from a feed in no order, most of it behind any watermark."""
    keys, totals = ["window_start", "event_type"], {"total": "sum"}
    feed, path = _shuffled_feed(_events(spark, folder), "late-events"), scratch_path(spark, "event-sums")

    def counted(batch: DataFrame) -> DataFrame:
        found = metrics.event_counters(batch, ["event_type"], "1 hour")
        return found.withColumn("window_start", F.col("window_start").cast("timestamp"))

    finish(sums.keep_sums(feed, path, keys, totals, counted))
    state = sums.SumLog(spark, path, keys, totals).state("window_start timestamp, event_type string, total bigint")
    return _ntz(state, "window_start")


@query
def stream_order_totals(spark: SparkSession, folder: str) -> DataFrame:
    items = star.order_items(star.scan_stream(spark, folder, "lineitem"))
    totals = _run(feeds.order_total_changes(batches.change_feed(items)), ["order_id"])
    return money_to_double(totals)


FEED_BLOCK = 16 << 20


def _shuffled_feed(feed: DataFrame, label: str, files: int = 6) -> DataFrame:
    """A feed as a stream of files without any order, two of them in a batch."""
    path = scratch_path(feed.sparkSession, label)
    # Row groups of a task's size, or a batch of large files would be read by a few tasks.
    dealt = feed.repartition(files, F.xxhash64(*feed.columns))
    dealt.write.option("parquet.block.size", FEED_BLOCK).parquet(path)
    return feed.sparkSession.readStream.schema(feed.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query
def stream_order_totals_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """The same totals from a feed that delivers changes twice and in no order."""
    items = star.order_items(star.scan(spark, folder, "lineitem"))
    feed = _shuffled_feed(batches.delivered_twice(items), "repeated-feed")
    path = scratch_path(spark, "unique-changes")

    def unique_of(batch: DataFrame, log: ArrivalLog) -> DataFrame:
        seen = log.read(batch.select("change_id", "ts").schema)
        return feeds.unique_changes(batch, "20 years", seen, log.latest())

    finish(keep_new(feed, path, new=unique_of))
    unique = spark.readStream.schema(feed.schema).option("recursiveFileLookup", "true").parquet(path)
    return money_to_double(_run(feeds.order_total_changes(unique), ["order_id"]))


@query
def stream_client_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Orders told twice, items corrected, and everything in no order: items before orders, cancellations first or last."""
    t = star.star_tables(spark, folder)
    told, changes = batches.told_orders(t.orders), batches.item_changes(t.order_items)
    feed = _shuffled_feed(told.unionByName(changes, allowMissingColumns=True), "order-feed")
    states = _run(feeds.order_states(feed.where("seq IS NOT NULL"), feed.where("op IS NOT NULL")), ["order_id"])
    return feeds.client_summary(t.clients, states)
