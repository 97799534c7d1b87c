"""Change batches derived from the star-schema tables.

Each covers its whole source table and mixes good and bad rows, so that every
rejection reason occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.functions.numbers import order_number
from orderlytics.schemas import MONEY
from orderlytics.sources.star import scan
from orderlytics.sources.tables import Tables

UNKNOWN_ID_OFFSET = 1_000_000_000


def raw_clients(spark: SparkSession, folder: str) -> DataFrame:
    """Client records from `customer`: odd e-mails, long phones, missing addresses."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    return scan(spark, folder, "customer").select(
        key.alias("id"),
        F.when(segment == "MACHINERY", "").otherwise(F.col("c_name")).alias("name"),
        F.concat(
            F.lower(segment),
            F.when(F.col("c_acctbal") < 0, "at").otherwise("@"),
            F.when(F.col("c_nationkey") < 5, "localhost").otherwise("example.com"),
        ).alias("email"),
        F.concat(F.lit("+"), F.repeat(F.lit("7"), F.col("c_nationkey"))).alias("phone"),
        F.when(segment != "BUILDING", segment).alias("address"),
    )


def raw_products(spark: SparkSession, folder: str) -> DataFrame:
    """Product records from `part`: free, negative and unpriced ones among them."""
    return scan(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("sku"),
        (F.col("p_size") - 5).alias("quantity"),
        F.when(F.col("p_type") != "ECONOMY", (F.col("p_retailprice") - 950).cast(MONEY)).alias("price"),
        (F.col("p_size") - 3).cast(MONEY).alias("cost"),
        F.when(F.col("p_brand") != "Brand#1", F.lit(100).cast("bigint")).alias("category_id"),
    )


def raw_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Category records from `supplier`: empty, missing, too long and just fitting names."""
    nation = F.col("s_nationkey")
    return scan(spark, folder, "supplier").select(
        (F.col("s_suppkey") + 1000).alias("id"),
        F.when(nation % 6 == 0, "")
        .when(nation % 6 == 2, F.repeat(F.lit("x"), 256))
        .when(nation % 6 == 3, F.repeat(F.lit("é"), 255))
        .when(nation % 6 != 1, F.col("s_name"))
        .alias("name"),
    )


def twin_categories(t: Tables) -> DataFrame:
    """The categories, every fifth of them twice: a sibling of its own name."""
    twins = t.categories.where("id % 5 = 0").withColumn("id", F.col("id") + UNKNOWN_ID_OFFSET)
    return t.categories.unionByName(twins)


def offered_orders(t: Tables) -> DataFrame:
    """All orders as new ones: some bring a stored number, a number that another brings, or one of
    the shop's series; some come a second time a day later, some under the id of a stored order."""
    key = F.col("id")
    number = (
        F.when(key % 17 == 0, F.col("order_number"))
        .when(key % 19 == 0, F.concat(F.lit("WEB-"), F.floor(key / 38).cast("string")))
        .when(key % 23 == 0, order_number(key + 5_000_000))
    )
    batch = t.orders.withColumn("order_number", number)
    later = (F.col("order_date") + F.expr("INTERVAL 1 DAY")).cast(t.orders.schema["order_date"].dataType)
    bare = batch.withColumn("order_number", F.lit(None).cast("string"))
    again = bare.where("id % 11 = 0").withColumn("order_date", later)
    stored = bare.where("id % 13 = 0").withColumn("id", key + UNKNOWN_ID_OFFSET)
    return batch.unionByName(again).unionByName(stored)


def raw_items(t: Tables) -> DataFrame:
    """Item records in which some quantities and prices are not positive."""
    return t.order_items.select(
        "order_id",
        *t.item_key[:-2],
        (F.col("quantity") - 3).alias("quantity"),
        F.when(F.col("l_returnflag") == "R", F.col("price") - 2000).otherwise(F.col("price")).cast(MONEY).alias("price"),
        "total_price",
    )


def raw_orders(t: Tables) -> DataFrame:
    """Order records with one status the input does not know."""
    status = F.when(F.col("status") == "refunded", "returned").otherwise(F.col("status"))
    return t.orders.select("id", "client_id", status.alias("status"), "payment_status")


def intake_items(t: Tables) -> DataFrame:
    """Items offered at the current price, except some returned ones that cost one more."""
    current = t.nomenclature.select(F.col("id").alias("nomenclature_id"), F.col("price").alias("current"))
    stale = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    return (
        t.order_items.drop("price")
        .join(current, "nomenclature_id")
        .withColumn("price", (F.col("current") + F.when(stale, 1).otherwise(0)).cast(MONEY))
        .drop("current")
    )


def unnumbered_orders(t: Tables) -> DataFrame:
    """All orders as new ones: numbers missing, empty, foreign, or explicit and running ahead."""
    given = (
        F.when(F.col("payment_status") == "unpaid", F.lit(None).cast("string"))
        .when(F.col("payment_status") == "refunded", "")
        .when(F.col("payment_status") == "partial", F.concat(F.lit("WEB-"), F.col("id").cast("string")))
        .otherwise(order_number(F.col("id") * 3 + 200_000))
    )
    return t.orders.withColumn("order_number", given)


def client_patches(spark: SparkSession, folder: str) -> DataFrame:
    """One client patch per order; some name unknown clients or change nothing."""
    key, priority, state = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    unknown = (state == "P") & (priority == "1-URGENT")
    return scan(spark, folder, "orders").select(
        key.alias("seq"),
        (F.col("o_custkey") + F.when(unknown, UNKNOWN_ID_OFFSET).otherwise(0)).alias("id"),
        F.when(priority == "1-URGENT", F.concat(F.lit("Client "), key.cast("string"))).alias("name"),
        F.when(priority == "2-HIGH", F.concat(F.lit("c"), (key % 3000).cast("string"), F.lit("@example.com")))
        .when((priority == "4-NOT SPECIFIED") & (state == "O"), "nobody")
        .alias("email"),
        F.when(priority.isin("3-MEDIUM", "4-NOT SPECIFIED"), F.concat(F.lit("Street "), state)).alias("address"),
    )


def product_patches(spark: SparkSession, folder: str) -> DataFrame:
    """One patch per part: new articles, categories and prices, some of them not allowed."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return scan(spark, folder, "part").select(
        key.alias("seq"),
        key.alias("id"),
        F.when(size < 20, F.concat(F.lit("SKU-"), F.floor(key / 2).cast("string")))
        .when(size < 30, F.concat(F.lit("NEW-"), F.floor(key / 4).cast("string")))
        .alias("sku"),
        F.when(size > 40, key % 30 + 100).alias("category_id"),
        F.when(F.col("p_type") == "ECONOMY", (F.col("p_retailprice") - 910).cast(MONEY)).alias("price"),
    )


def category_patches(spark: SparkSession, folder: str) -> DataFrame:
    """One patch per supplier category: moved, renamed, switched off or left as it is."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return scan(spark, folder, "supplier").select(
        key.alias("seq"),
        (key + 1000).alias("id"),
        F.when(nation < 10, F.concat(F.lit("Line "), key.cast("string"))).alias("name"),
        F.when((nation >= 5) & (nation < 20), (nation * 2 + 100).cast("bigint"))
        .when(nation == 21, F.lit(3).cast("bigint"))
        .alias("parent_id"),
        F.when(nation == 20, False).alias("is_active"),
    )


def order_patches(spark: SparkSession, folder: str) -> DataFrame:
    """One status patch per order; some states and some orders do not exist."""
    key, priority, state = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    return scan(spark, folder, "orders").select(
        key.alias("seq"),
        (key + F.when(F.col("o_totalprice") < 10_000, UNKNOWN_ID_OFFSET).otherwise(0)).alias("id"),
        F.when(priority == "1-URGENT", "completed").when(priority == "2-HIGH", "lost").alias("status"),
        F.when(state == "P", "paid").when(priority == "3-MEDIUM", "partial").alias("payment_status"),
    )


def new_clients(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers that become clients: shared and taken e-mails, some without address."""
    key = F.col("s_suppkey")
    return scan(spark, folder, "supplier").select(
        key.alias("seq"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("c"), (key % 40 * 50).cast("string"), F.lit("@example.com")).alias("email"),
        F.when(F.col("s_acctbal") >= 0, "Dock").alias("address"),
    )


def new_products(spark: SparkSession, folder: str) -> DataFrame:
    """Successors of all parts: taken articles, missing categories, prices of zero or less."""
    key = F.col("p_partkey")
    return scan(spark, folder, "part").select(
        key.alias("seq"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("SKU-"), F.floor(key * 3 / 2).cast("string")).alias("sku"),
        (F.col("p_retailprice") - 910).cast(MONEY).alias("price"),
        (key % 30 + 100).alias("category_id"),
    )


def new_categories(spark: SparkSession, folder: str) -> DataFrame:
    """One category per supplier under its nation or, when in debt, at the top."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return scan(spark, folder, "supplier").select(
        key.alias("seq"),
        F.concat(F.lit("Range "), F.col("s_nationkey").cast("string")).alias("name"),
        F.when(F.col("s_acctbal") >= 0, nation + 100).cast("bigint").alias("parent_id"),
    )


def switched_categories(spark: SparkSession, folder: str) -> DataFrame:
    """One patch per supplier that switches its nation, some of them with a parent that does not exist."""
    key = F.col("s_suppkey")
    return scan(spark, folder, "supplier").select(
        (key * 40 + 1).alias("seq"),
        (F.col("s_nationkey") + 100).cast("bigint").alias("id"),
        F.when(key % 4 == 0, F.lit(UNKNOWN_ID_OFFSET).cast("bigint")).alias("parent_id"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
    )


def with_unknown(ids: DataFrame) -> DataFrame:
    """All ids, and as many that do not exist."""
    return ids.unionByName(ids.select((F.col("id") + UNKNOWN_ID_OFFSET).alias("id")))


def change_feed(items: DataFrame) -> DataFrame:
    """Item changes: all inserted, `A` rows later repriced, `R` rows later deleted."""
    total, repriced = F.col("total_price"), F.col("quantity").cast(MONEY)
    none = F.lit(None).cast(MONEY)

    def change(op: str, old: F.Column, new: F.Column) -> F.Column:
        return F.struct(F.lit(op).alias("op"), old.alias("old_total"), new.alias("new_total"))

    insert = change("insert", none, total)
    changes = (
        F.when(F.col("l_returnflag") == "A", F.array(insert, change("update", total, repriced)))
        .when(F.col("l_returnflag") == "R", F.array(insert, change("delete", total, none)))
        .otherwise(F.array(insert))
    )
    return items.select("order_id", F.inline(changes))


def told_orders(orders: DataFrame) -> DataFrame:
    """Every order told twice: first in processing and, each seventh, under the next client, then as it is."""
    moved = F.when(F.col("id") % 7 == 0, F.col("client_id") + 1).otherwise(F.col("client_id"))
    first = orders.select(F.lit(1).alias("seq"), "id", moved.alias("client_id"), F.lit("processing").alias("status"), "order_date")
    return first.unionByName(orders.select(F.lit(2).alias("seq"), "id", "client_id", "status", "order_date"))


def item_changes(items: DataFrame) -> DataFrame:
    """Every item inserted; returned ones at a price that is corrected afterwards."""
    total, wrong = F.col("total_price"), (F.col("total_price") + 1).cast(MONEY)
    none = F.lit(None).cast(MONEY)

    def change(op: str, old: F.Column, new: F.Column) -> F.Column:
        return F.struct(F.lit(op).alias("op"), old.alias("old_total"), new.alias("new_total"))

    corrected = F.array(change("insert", none, wrong), change("update", wrong, total))
    changes = F.when(F.col("l_returnflag") == "R", corrected).otherwise(F.array(change("insert", none, total)))
    return items.select("order_id", F.inline(changes))


def delivered_twice(items: DataFrame) -> DataFrame:
    """The change feed with an id and a time for each change, a third of them delivered again."""
    feed = change_feed(items).withColumns(
        {"change_id": F.monotonically_increasing_id(), "ts": F.timestamp_seconds(1_700_000_000 + F.col("order_id") % 1_000_000)}
    )
    copies = F.when(F.col("change_id") % 3 == 0, 2).otherwise(1)
    return feed.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


def broken_categories(spark: SparkSession, folder: str, t: Tables) -> DataFrame:
    """The tree with root 1 moved below one of its own children and root 4 below a missing node."""
    child = scan(spark, folder, "nation").where("n_regionkey = 1").agg(F.min("n_nationkey") + 100).first()[0]
    moved = F.when(F.col("id") == 1, child).when(F.col("id") == 4, 999).otherwise(F.col("parent_id"))
    return t.categories.withColumn("parent_id", moved.cast("bigint"))
