"""Tasks stay small whatever the size of a table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orderlytics.operators.reports import item_totals
from orderlytics.session import tune


@pytest.fixture
def one_task_is_enough(spark):
    """As on a table so large that every task of the cluster gets its fill."""
    names = ("spark.sql.files.minPartitionNum", "spark.sql.adaptive.coalescePartitions.minPartitionNum")
    for name in names:
        spark.conf.set(name, "1")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield tune(spark)
    for name in names:
        spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_task_gets_a_small_share_of_files_and_shuffles(one_task_is_enough, tmp_path):
    spark, path = one_task_is_enough, str(tmp_path / "items")
    items = spark.range(0, 3_000_000, 1, 1).select(
        F.xxhash64("id").alias("order_id"), F.xxhash64("id", F.lit(1)).alias("total_price")
    )
    items.write.parquet(path)  # 48 MB that do not compress
    stored = spark.read.parquet(path)
    assert stored.rdd.getNumPartitions() >= 3
    totals = item_totals(stored).withColumn("task", F.spark_partition_id())
    assert totals.select("task").distinct().count() >= 2
