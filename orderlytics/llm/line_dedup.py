"""Line deduplication over levelled sorted runs of line hashes.

A run is a Parquet folder with one row per line key: a 128-bit hash and the
number of documents that hold it, sorted by hash. Every new batch adds a run; as
soon as `fan_out` runs of a level stand side by side they are merged into one run
of the next level, so a corpus of n batches keeps O(log n) runs and every row is
rewritten O(log n) times. A batch is cleaned by a merge anti-join of its lines with
the runs. Everything is made of DataFrame expressions.

A run is named by the first and the last batch it holds. One that covers others
replaces them from the moment its write is finished, so the folder itself says
which runs count: a later session opens it and goes on, a reader never counts a
batch twice, and a failed write leaves nothing that counts. One writer at a time.

A document is a row; rows that repeat a doc_id count once each. A NULL or empty
text is one empty line. An empty key is never dropped. No documents: no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.llm.common import BLANKS, ROW, ascii_lower, text_of, wrapped
from orderlytics.session import cut_lineage, drop_scratch, finished_folders, scratch_path

MIN_DOCS = 10
FAN_OUT = 4
KEY = ["hash_a", "hash_b"]
RUN_SCHEMA = "hash_a bigint, hash_b bigint, docs bigint"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    """Two hashes with different seeds; together 128 bits."""
    return [F.xxhash64(key).alias("hash_a"), F.xxhash64(F.lit("line"), key).alias("hash_b")]


class Run(NamedTuple):
    first: int
    last: int

    @property
    def batches(self) -> int:
        return self.last - self.first + 1


class LineRuns:
    """The store: sorted runs in a shared folder, those of an earlier session included."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT, folder: str | None = None) -> None:
        if fan_out < 2:
            raise ValueError("fan_out must be at least 2")
        self.spark, self.fan_out = spark, fan_out
        self.folder = folder or scratch_path(spark, "line-runs")

    def _finished(self) -> list[Run]:
        return [Run(*map(int, name.split("-"))) for name in finished_folders(self.spark, self.folder)]

    def runs(self) -> list[Run]:
        """The runs that count, by batches: none lies within another."""
        chosen: list[Run] = []
        for run in sorted(self._finished(), key=lambda r: (r.first, -r.last)):
            if not chosen or run.first > chosen[-1].last:
                chosen.append(run)
        return chosen

    def _path(self, run: Run) -> str:
        return f"{self.folder}/{run.first:010d}-{run.last:010d}"

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Count the documents of each line of a batch and keep them as a run."""
        keys = F.array_distinct(F.transform(F.split(text_of(text), "\n", -1), line_key))
        lines = docs.select(F.explode(keys).alias("key")).where("key <> ''").select(*_hashes(F.col("key")))
        held = self.runs()
        batch = held[-1].last + 1 if held else 0
        self._write(Run(batch, batch), lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs")))
        self._compact()

    def _write(self, run: Run, counts: DataFrame) -> None:
        counts.sortWithinPartitions(*KEY).write.mode("overwrite").parquet(self._path(run))

    def _compact(self) -> None:
        """Merge the youngest runs while `fan_out` of them are equally large; drop what others cover."""
        while True:
            held = self.runs()
            for run in self._finished():
                if run not in held:
                    drop_scratch(self.spark, self._path(run))
            young = held[-self.fan_out :]
            if len(young) < self.fan_out or len({r.batches for r in young}) > 1:
                return
            self._write(Run(young[0].first, young[-1].last), self._total(young))

    def _total(self, runs: list[Run]) -> DataFrame:
        rows = self.spark.read.schema(RUN_SCHEMA).parquet(*map(self._path, runs))
        return rows if len(runs) == 1 else rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"))

    def counts(self) -> DataFrame:
        """Documents by line hash over all runs."""
        held = self.runs()
        return self._total(held) if held else self.spark.createDataFrame([], RUN_SCHEMA)

    def close(self) -> None:
        """Remove the store."""
        drop_scratch(self.spark, self.folder)


def without_known_lines(
    docs: DataFrame, runs: LineRuns, min_docs: int = MIN_DOCS, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """Rows (wrapped) with `kept_text`, `n_lines`, `n_dropped`: lines that the runs know
    from at least `min_docs` documents are gone.

    Only hashes and positions meet the runs; the text itself is shuffled once,
    by row, so that a line in every document makes no partition larger.
    """
    lines = F.split(text_of(text), "\n", -1)
    # Rows with equal id and text have equal lines, so this serves as their name.
    name = [F.xxhash64(id, text).alias("name_a"), F.xxhash64(F.lit("row"), id, text).alias("name_b")]
    rows = docs.select(wrapped(docs), text_of(text).alias("body"), *name)
    known = runs.counts().where(F.col("docs") >= min_docs).select(*KEY)
    known = cut_lineage(known, "known-lines")
    each = (
        docs.select(*name, F.posexplode(lines).alias("pos", "line"))
        .select("name_a", "name_b", "pos", line_key(F.col("line")).alias("key"))
        .select("name_a", "name_b", "pos", *_hashes(F.col("key")))
    )
    fresh = each.hint("merge").join(known, KEY, "left_anti")
    stay = fresh.groupBy("name_a", "name_b").agg(F.array_sort(F.collect_set("pos")).alias("stay"))
    joined = rows.join(stay.hint("shuffle_hash"), ["name_a", "name_b"], "left")
    split = F.split("body", "\n", -1)
    stayed = F.coalesce("stay", F.array().cast("array<int>"))
    # The outer transform binds the lines once for all positions.
    picked = F.transform(
        F.array(split), lambda lines: F.array_join(F.transform(stayed, lambda p: F.get(lines, p)), "\n")
    )
    return joined.select(
        ROW,
        F.when(F.size(stayed) == F.size(split), F.col("body")).otherwise(F.get(picked, F.lit(0))).alias("kept_text"),
        F.size(split).cast("bigint").alias("n_lines"),
        (F.size(split) - F.size(stayed)).cast("bigint").alias("n_dropped"),
    )
