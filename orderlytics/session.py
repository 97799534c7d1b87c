"""Session settings and the shared folder that holds intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Runtime settings every job in this package relies on. Partition counts and
# memory belong to the cluster and are left alone.
# Narrow tables hold many rows in a MB and a row takes some 300 bytes in a hash
# table or sort, so a task gets 16 MB of a file or shuffle, not Spark's 128 and 64.
TASK_BYTES = "16m"
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.files.maxPartitionBytes": TASK_BYTES,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES,
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on order_id that feeds an aggregate on (order_id, product) reuses
    # the join's partitioning. When one order is hot, splitting it is worth the
    # extra shuffle; without skew this setting changes nothing.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "orderlytics", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_scratch()
    return root.rstrip("/")


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="orderlytics-")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def write_counted(df: DataFrame, path: str) -> int:
    """Write a table and return its row count from the same job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return seen.get["rows"]


def read_back(df: DataFrame, *paths: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(*paths)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Replace a plan by a table written to the shared folder.

    Survives lost executors, keeps column pruning, and gives Spark the true
    size of the data for the joins that follow.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return read_back(df, path)


def finished_folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the subfolders that a write has finished; what a failed write left does not count."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    root = to_path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [f.getPath().getName() for f in system.listStatus(root)]
    return sorted(n for n in names if system.exists(to_path(f"{folder}/{n}/_SUCCESS")))


def drop_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Remove one intermediate table, or all of this application's."""
    target = path or f"{scratch_root(spark)}/{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
