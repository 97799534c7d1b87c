"""A table as versions that share files: a change rewrites only the files it touches.

A version is a list of files. A commit finds the files that hold a changed or deleted
key by reading the key column alone, writes the other rows of these files together
with the new ones, and publishes a list in which the written files stand for the
touched ones. All other files are shared with the version before, which stays as it
was for its readers. Rows are sorted by key, so ids that lie together share files.
A key may name several rows, as an order names its items: a change then replaces them
all. Rows of one key are spread over as many tasks and files as they need.

A version exists once its list is written; what a failed commit left is overwritten
by the next. One writer at a time, any number of readers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderlytics.session import cut_lineage, drop_scratch, finished_folders

FILE_ROWS = 1_000_000
FILE = "_version_file"


@dataclass(frozen=True)
class VersionedTable:
    """A folder with `data` (files of all versions) and `versions` (lists of files)."""

    spark: SparkSession
    folder: str
    schema: StructType
    key: str = "id"
    file_rows: int = FILE_ROWS

    @classmethod
    def create(cls, df: DataFrame, folder: str, key: str = "id", file_rows: int = FILE_ROWS) -> VersionedTable:
        """Store a table as version 0. `key` names its rows; none is NULL."""
        table = cls(df.sparkSession, folder.rstrip("/"), df.schema, key, file_rows)
        if table.versions():
            raise ValueError(f"{folder} holds a table already")
        table._publish(0, table._written(df, 0))
        return table

    def versions(self) -> list[int]:
        return [int(name) for name in finished_folders(self.spark, f"{self.folder}/versions")]

    def files(self, version: int | None = None) -> DataFrame:
        """(part, name): the files of a version, by default of the latest."""
        known = self.versions()
        wanted = known[-1] if version is None else version
        if wanted not in known:
            raise ValueError(f"no version {wanted} of {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/versions/{wanted:010d}")

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.files(version))

    def commit(self, changed: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Publish a version in which `changed` rows replace those of their key or are added, and keys in `gone` are missing.

        A key in both is gone. Returns the number of the new version.
        """
        files = self.files()
        version = self.versions()[-1] + 1
        empty = self.spark.createDataFrame([], self.schema)
        # Files of another type could not be read: a value that the stored type cannot hold fails the commit.
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        new = empty if changed is None else changed.select(*typed)
        dead = (empty if gone is None else gone).select(self.key).distinct()
        # Read twice below: once for the keys, once for the rows.
        new = cut_lineage(new.join(dead, self.key, "left_anti").select(*self.schema.names), "changed-rows")
        touched = cut_lineage(new.select(self.key).unionByName(dead).distinct(), "touched-keys")
        held = self._rows(files, with_file=True)
        hit = cut_lineage(held.select(self.key, FILE).join(touched, self.key, "left_semi").select(FILE).distinct(), "touched-files")
        stale = files.join(hit, files.name == hit[FILE], "left_semi")
        spared = self._rows(stale).join(touched, self.key, "left_anti")
        written = self._written(spared.select(*self.schema.names).unionByName(new), version)
        self._publish(version, files.join(hit, files.name == hit[FILE], "left_anti").unionByName(written))
        return version

    def forget(self, keep: int = 1) -> None:
        """Remove all but the last `keep` versions, and the files that only they name."""
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        needed = self.files(kept[0]).select("name")
        for version in kept[1:]:
            needed = needed.unionByName(self.files(version).select("name"))
        for version in old:
            for file in self.files(version).join(needed, "name", "left_anti").collect():
                drop_scratch(self.spark, f"{self.folder}/data/{file.part}/{file.name}")
        for version in old:
            drop_scratch(self.spark, f"{self.folder}/versions/{version:010d}")

    def _rows(self, files: DataFrame, with_file: bool = False) -> DataFrame:
        paths = [f"{self.folder}/data/{f.part}/{f.name}" for f in files.collect()]
        if not paths:
            rows = self.spark.createDataFrame([], self.schema)
            return rows.withColumn(FILE, F.lit("")) if with_file else rows
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.withColumn(FILE, F.col("_metadata.file_name")) if with_file else rows

    def _written(self, df: DataFrame, version: int) -> DataFrame:
        part = f"{version:010d}"
        path = f"{self.folder}/data/{part}"
        ranged = df.repartitionByRange(self.key, F.xxhash64(*df.columns)).sortWithinPartitions(self.key)
        ranged.write.mode("overwrite").option("maxRecordsPerFile", self.file_rows).parquet(path)
        names = self.spark.read.schema(self.schema).parquet(path).select(F.col("_metadata.file_name").alias("name"))
        return names.distinct().select(F.lit(part).alias("part"), "name")

    def _publish(self, version: int, files: DataFrame) -> None:
        # One row per file: few, and written as one file.
        files.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/{version:010d}")
