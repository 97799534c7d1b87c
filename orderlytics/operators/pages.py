"""Page index: a sorted copy of a list, kept as long as its table version.

Building sorts the rows once, in parallel, and writes files of at most
`file_rows` rows, in order from file to file. The index has one row per file: how
many rows stand before it, how many it has, and its first and last key. A page by
number and a page after a key then read only the files they lie in, at any depth.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlytics.operators.search import MAX_PAGE_SIZE

FILE_ROWS = 100_000
FILE = "_page_file"


@dataclass(frozen=True)
class PageIndex:
    """A folder with `rows` (the sorted files) and `files` (the index)."""

    spark: SparkSession
    folder: str
    order: tuple[str, ...]

    @classmethod
    def build(cls, df: DataFrame, order: Sequence[str], folder: str, file_rows: int = FILE_ROWS) -> PageIndex:
        """Sort and index a list. `order` names columns whose values together are unique; NULL comes first."""
        spark = df.sparkSession
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
        ranged.write.option("maxRecordsPerFile", file_rows).parquet(f"{folder}/rows")
        found = spark.read.schema(df.schema).parquet(f"{folder}/rows").withColumn(FILE, F.col("_metadata.file_name"))
        key = F.struct(*order)
        files = found.groupBy(FILE).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key")
        )
        # One row per file: few, and written as one file.
        before = Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)
        files = files.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        files.coalesce(1).write.parquet(f"{folder}/files")
        return cls(spark, folder, tuple(order))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> PageIndex:
        """An index that an earlier session built."""
        key = spark.read.parquet(f"{folder}/files").schema["first_key"].dataType
        return cls(spark, folder, tuple(key.names))

    def _files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/files")

    def _rows(self, files: list[str]) -> DataFrame:
        schema = self._schema()
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/rows/{f}" for f in files])

    def _schema(self):
        return self.spark.read.parquet(f"{self.folder}/rows").schema

    def totals(self, size: int = 20) -> DataFrame:
        """One row: how many rows and pages there are; no row is read."""
        total = F.coalesce(F.sum("n"), F.lit(0))
        return self._files().agg(total.alias("total"), F.ceil(total / size).cast("bigint").alias("pages"))

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        """Rows of one page, from the one or two files it lies in."""
        _check(number, size)
        skip = (number - 1) * size
        held = self._files().where((F.col("before") < skip + size) & (F.col("before") + F.col("n") > skip))
        held = held.orderBy("before").select(FILE, "before").limit(size + 1).collect()
        first = held[0].before if held else 0
        rows = self._rows([r[FILE] for r in held])
        return rows.orderBy(*self.order).offset(max(skip - first, 0)).limit(size)

    def page_after(self, last: Sequence | None, size: int = 20) -> DataFrame:
        """The page that follows the row with this key, given in the order of the index; the first page without one."""
        _check(1, size)
        if last is None:
            return self.page(1, size)
        key = F.struct(*[F.lit(v).cast(self._schema()[c].dataType).alias(c) for c, v in zip(self.order, last, strict=True)])
        # Files with rows beyond the key; so many of them, each with a row at least, hold a page.
        held = self._files().where(F.col("last_key") > key).orderBy("before").select(FILE).limit(size + 1).collect()
        rows = self._rows([r[FILE] for r in held])
        return rows.where(F.struct(*self.order) > key).orderBy(*self.order).limit(size)


def _check(number: int, size: int) -> None:
    if number < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"size must be between 1 and {MAX_PAGE_SIZE}")
