"""A stored shop laid out by hash of its join keys: joins and sums on them do not shuffle the stored side.

Orders lie by their id, items by their order, both in the same number of buckets, so an
order and its items are always in buckets of one number. Clients, products and categories
lie by id. For each unique column there is an index, (value, id) laid out by the value,
which batches are checked against. A filter on a key reads one bucket.

A bucket is read by one task. Keys with more than `heavy_rows` rows therefore lie apart,
not bucketed; a table that has some is the union of both parts, which Spark shuffles as
it would any table, combined on the map side. Rows without a key lie there too, if many.

The folder holds the files and, written last, a list of layouts: a folder without it holds
no shop. Spark's catalog must know a bucketed table by name; `open` registers the names
in any later session.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderlytics.session import cut_lineage, read_back
from orderlytics.sources.tables import Tables

BUCKET_ROWS = 4_000_000
HEAVY_ROWS = 1_000_000

#: Column by which a table lies; tables of one family have the same number of buckets.
KEYS = {"categories": "id", "nomenclature": "id", "clients": "id", "orders": "id", "order_items": "order_id"}
FAMILY = {"orders": "order_items"}
#: Columns whose values no two rows share.
UNIQUE = {"clients": "email", "nomenclature": "sku", "orders": "order_number"}


@dataclass(frozen=True)
class BucketedShop:
    """The tables and unique indexes of a folder, as `write` or `open` found them."""

    tables: Tables
    buckets: Mapping[str, int]


def write(
    t: Tables, folder: str, bucket_rows: int = BUCKET_ROWS, heavy_rows: int = HEAVY_ROWS
) -> BucketedShop:
    """Store a shop in an empty folder, in buckets of some `bucket_rows` rows."""
    spark = t.orders.sparkSession
    folder = folder.rstrip("/")
    parts = {name: (getattr(t, name), key) for name, key in KEYS.items()}
    for name, column in UNIQUE.items():
        held = getattr(t, name).where(F.col(column) != "").select(column, "id")
        parts[f"{name}_{column}"] = (held, column)
    rows = {name: df.count() for name, (df, _) in parts.items()}
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    layouts = []
    for name, (df, key) in parts.items():
        wanted = max(rows[name], rows.get(FAMILY.get(name), 0), *[rows[n] for n, f in FAMILY.items() if f == name], 1)
        buckets = min(-(-wanted // bucket_rows), most)
        heavy = _write_part(df, key, buckets, f"{folder}/{name}", heavy_rows)
        layouts.append((name, key, buckets, heavy, df.schema.json()))
    columns = "name string, key string, buckets int, heavy boolean, schema string"
    # One row per table: at most some ten.
    spark.createDataFrame(layouts, columns).coalesce(1).write.parquet(f"{folder}/layouts")
    return open_shop(spark, folder, t.item_key)


def _write_part(df: DataFrame, key: str, buckets: int, path: str, heavy_rows: int) -> bool:
    """Write the buckets, and rows of heavy keys apart; True if there are such."""
    # The count of a key is combined on the map side, so a hot one gathers nowhere.
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > heavy_rows)
    hot = cut_lineage(counted.select(F.col(key).alias("_hot")), "heavy-keys")
    some = not hot.isEmpty()
    light = df
    if some:
        same = F.col(key).eqNullSafe(F.col("_hot"))
        df.join(hot, same, "left_semi").write.parquet(f"{path}-heavy")
        light = df.join(hot, same, "left_anti")
    # Tasks are buckets: the writer's hash is that of `repartition`, so a bucket is one file.
    placed = light.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    placed.option("path", f"{path}-light").saveAsTable(_catalog_name(path))
    return some


def _catalog_name(path: str) -> str:
    return f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:32]}"


def open_shop(spark: SparkSession, folder: str, item_key: tuple[str, ...] = ("id",)) -> BucketedShop:
    """A stored shop; `item_key` orders the items of one order."""
    folder = folder.rstrip("/")
    found, buckets = {}, {}
    for row in spark.read.parquet(f"{folder}/layouts").collect():
        path = f"{folder}/{row.name}"
        found[row.name] = _registered(spark, path, row)
        buckets[row.name] = row.buckets
    indexes = {name: found.pop(f"{name}_{column}") for name, column in UNIQUE.items()}
    return BucketedShop(Tables(**found, item_key=item_key, unique=indexes), buckets)


def _registered(spark: SparkSession, path: str, layout) -> DataFrame:
    name = _catalog_name(path)
    if not spark.catalog.tableExists(name):
        schema = _ddl(layout.schema)
        spark.sql(
            f"CREATE TABLE {name} ({schema}) USING parquet "
            f"CLUSTERED BY (`{layout.key}`) SORTED BY (`{layout.key}`) INTO {layout.buckets} BUCKETS "
            f"LOCATION '{path}-light'"
        )
    light = spark.table(name)
    return light.unionByName(read_back(light, f"{path}-heavy")) if layout.heavy else light


def _ddl(schema: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(schema)))


def forget(spark: SparkSession, folder: str) -> None:
    """Remove the names of a folder's tables from the catalog; the files stay."""
    folder = folder.rstrip("/")
    for row in spark.read.parquet(f"{folder}/layouts").collect():
        spark.sql(f"DROP TABLE IF EXISTS {_catalog_name(f'{folder}/{row.name}')}")
