"""The star-schema Parquet tables seen as the five logical tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderlytics.functions.numbers import order_number
from orderlytics.schemas import MONEY
from orderlytics.sources.tables import Tables

# lineitem has no single-column key; these columns together are one.
ITEM_KEY = ("nomenclature_id", "l_suppkey", "l_linenumber", "quantity", "total_price")


@cache
def _schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; its schema is taken from a file footer once per session."""
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def scan_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of one table as a stream."""
    schema = _schema(spark, f"{folder}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def star_tables(spark: SparkSession, folder: str) -> Tables:
    region, nation, customer, supplier, part, orders_, lineitem = (
        scan(spark, folder, name)
        for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    )
    return Tables(
        categories=categories(region, nation, supplier),
        nomenclature=nomenclature(part),
        clients=clients(customer),
        orders=orders(orders_),
        order_items=order_items(lineitem),
        item_key=ITEM_KEY,
    )


def clients(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    address = F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com"))
    return customer.select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.when(key % 10 != 0, address).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.col("c_mktsegment").alias("address"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def orders(raw: DataFrame) -> DataFrame:
    state, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    status = (
        F.when(state == "F", "completed")
        .when((state == "O") & (priority == "5-LOW"), "refunded")
        .when(state == "O", "pending")
        .when(priority.isin("1-URGENT", "2-HIGH"), "processing")
        .otherwise("cancelled")
    )
    payment = (
        F.when(priority == "1-URGENT", "paid")
        .when(priority == "2-HIGH", "partial")
        .when(priority == "5-LOW", "refunded")
        .otherwise("unpaid")
    )
    return raw.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("client_id"),
        order_number(F.col("o_orderkey") + 1).alias("order_number"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        status.alias("status"),
        payment.alias("payment_status"),
    )


def order_items(lineitem: DataFrame) -> DataFrame:
    # Whole cents per unit, rounded down: the same on every engine, which a
    # rounded double would not be.
    cents = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("decimal(12,0)")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("nomenclature_id"),
        "l_suppkey",
        "l_linenumber",
        F.col("l_quantity").cast("int").alias("quantity"),
        (cents * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY).alias("price"),
        F.col("l_extendedprice").cast(MONEY).alias("total_price"),
        "l_returnflag",
    )


def nomenclature(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(
        key.alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.concat(F.lit("SKU-"), key.cast("string")).alias("sku"),
        F.col("p_size").alias("quantity"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        (key % 25 + 100).alias("category_id"),
        (F.col("p_size") <= 45).alias("is_active"),
    )


def categories(region: DataFrame, nation: DataFrame, supplier: DataFrame) -> DataFrame:
    def level(df: DataFrame, key: F.Column, name: str, parent: F.Column, depth: int, active: F.Column) -> DataFrame:
        return df.select(
            key.cast("bigint").alias("id"),
            F.col(name).alias("name"),
            parent.cast("bigint").alias("parent_id"),
            F.lit(depth).alias("level"),
            active.alias("is_active"),
        )

    always = F.lit(True)
    roots = level(region, F.col("r_regionkey"), "r_name", F.lit(None), 0, always)
    middle = level(
        nation, F.col("n_nationkey") + 100, "n_name", F.col("n_regionkey"), 1, F.col("n_nationkey") % 10 != 7
    )
    leaves = level(supplier, F.col("s_suppkey") + 1000, "s_name", F.col("s_nationkey") + 100, 2, always)
    return roots.unionByName(middle).unionByName(leaves)
