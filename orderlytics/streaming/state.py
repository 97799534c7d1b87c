"""Keeping the latest state of a streaming aggregate as a table.

In update mode every micro-batch brings the keys whose value changed, with their
whole value. Each batch is written to a folder of its own; the current state is
the latest row of each key. An `UpdateLog` keeps the number of folders small:
when a level has `fan_out` of them, they become one folder of the next level that
holds the latest row of each key. After n batches there are at most
`fan_out` folders on each of log(n) levels, and a row was rewritten log(n) times.

Which folders make up the state stands in a manifest. A new manifest is written
under the next number and appears by one rename, so a reader sees the folders
before a merge or those after it, never both. Folders a merge replaced stay until
`keep` further manifests were written, for readers that still hold an old one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from orderlytics.session import drop_scratch, scratch_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAN_OUT = 8
KEEP = 8
BATCH = "batch_id"


@dataclass(frozen=True)
class Part:
    """A folder with the latest rows of the batches from `first` to `last`."""

    level: int
    first: int
    last: int
    folder: str


class UpdateLog:
    """Folders of changed rows under `path`, written by one query at a time and read by any number."""

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], fan_out: int = FAN_OUT, keep: int = KEEP
    ) -> None:
        if fan_out < 2:
            raise ValueError("fan_out must be at least 2")
        self.spark, self.path, self.keys, self.fan_out, self.keep = spark, path.rstrip("/"), [*keys], fan_out, keep

    # --- manifests

    def _file(self, name: str):
        """The file system and a path below this log."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        system, folder = self._file("manifest")
        if not system.exists(folder):
            return []
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int) -> list[Part]:
        system, path = self._file(f"manifest/{version:010d}")
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(system.open(path), "UTF-8")
        return [Part(**p) for p in json.loads(text)]

    def parts(self) -> list[Part]:
        """The folders that make up the state, the oldest batches first."""
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else []

    def _publish(self, parts: list[Part]) -> None:
        version = max(self._versions(), default=-1) + 1
        system, draft = self._file(f"manifest/.draft-{version:010d}")
        out = system.create(draft, True)
        out.write(bytearray(json.dumps([vars(p) for p in parts]).encode()))
        out.close()
        if not system.rename(draft, self._file(f"manifest/{version:010d}")[1]):
            raise RuntimeError(f"another writer published version {version} of {self.path}")

    # --- writing

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Keep the changed rows of a batch; one that is already in the log is not added again."""
        parts = self.parts()
        if parts and batch_id <= parts[-1].last:
            return
        part = Part(0, batch_id, batch_id, f"level-0/{batch_id:010d}")
        self._write(batch.withColumn(BATCH, F.lit(batch_id).cast("bigint")), part)
        self._publish([*parts, part])
        self._compact()

    def _write(self, rows: DataFrame, part: Part) -> None:
        # A folder that a failed attempt left is not in any manifest and is replaced.
        rows.write.mode("overwrite").parquet(f"{self.path}/{part.folder}")

    def _compact(self) -> None:
        parts, level = self.parts(), 0
        while len(old := [p for p in parts if p.level == level]) >= self.fan_out:
            first, last = old[0].first, old[-1].last
            merged = Part(level + 1, first, last, f"level-{level + 1}/{first:010d}-{last:010d}")
            self._write(self._merged(self._read(old), keep_batch=True), merged)
            parts = sorted([*(p for p in parts if p.level != level), merged], key=lambda p: p.first)
            self._publish(parts)
            level += 1
        self._forget()

    def _forget(self) -> None:
        """Remove manifests older than the last `keep`, and folders that only they name."""
        versions = self._versions()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        if not old:
            return
        needed = {p.folder for v in kept for p in self._manifest(v)}
        for version in old:
            for folder in {p.folder for p in self._manifest(version)} - needed:
                drop_scratch(self.spark, f"{self.path}/{folder}")
            drop_scratch(self.spark, f"{self.path}/manifest/{version:010d}")

    # --- reading

    def _read(self, parts: list[Part], schema: str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(f"{schema}, {BATCH} bigint")
        return reader.parquet(*[f"{self.path}/{p.folder}" for p in parts])

    def state(self, schema: str) -> DataFrame:
        """The latest row of every key; no rows before the first batch."""
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self._merged(self._read(parts, schema))

    def _merged(self, rows: DataFrame, keep_batch: bool = False) -> DataFrame:
        values = [c for c in rows.columns if c not in {*self.keys, BATCH}]
        kept = [*values, BATCH] if keep_batch else values
        latest = F.max_by(F.struct(*kept), BATCH).alias("_row")
        return rows.groupBy(*self.keys).agg(latest).select(*self.keys, "_row.*")


class ArrivalLog:
    """Rows kept of each micro-batch under `path`, a folder a batch; read it with `recursiveFileLookup`.

    A folder is written as a draft, which readers pass over, and appears by one
    rename. Its name has the batch and the latest time of all rows that came with it.
    """

    def __init__(self, spark: SparkSession, path: str, time: str = "ts") -> None:
        self.spark, self.path, self.time = spark, path.rstrip("/"), time

    def _folder(self, name: str = ""):
        """The file system and a path below this log, or that of the log."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def create(self) -> None:
        """Make the folder, so that it can be read as a stream before the first batch."""
        system, root = self._folder()
        system.mkdirs(root)

    def batches(self) -> list[tuple[int, int | None, str]]:
        """Number, latest microsecond and folder of each batch, the oldest first."""
        system, root = self._folder()
        if not system.exists(root):
            return []
        names = [f.getPath().getName() for f in system.listStatus(root)]
        parts = [(name.removeprefix("batch-").split("_"), name) for name in names if name.startswith("batch-")]
        return sorted((int(n), int(t) if t else None, name) for (n, t), name in parts)

    def latest(self) -> int | None:
        """The latest time, in microseconds of whole milliseconds, of all batches but the last.

        The next batch is judged by it, as in Spark's streams, where a watermark
        drops late rows and ids one batch after it was reached.
        """
        return max((t // 1000 * 1000 for _, t, _ in self.batches()[:-1] if t is not None), default=None)

    def read(self, schema: StructType) -> DataFrame:
        """What has been kept so far."""
        if not self.batches():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.path)

    def add(self, batch: DataFrame, batch_id: int, new: Callable[[DataFrame, ArrivalLog], DataFrame]) -> None:
        """Keep what `new` takes of a batch; one that is already in the log is not added again."""
        if any(n == batch_id for n, _, _ in self.batches()):
            return
        told, draft = Observation(), f".draft-{batch_id:010d}"
        arrived = batch.observe(told, F.unix_micros(F.max(self.time)).alias("latest"))
        new(arrived, self).write.mode("overwrite").parquet(f"{self.path}/{draft}")
        latest = told.get["latest"]
        system, source = self._folder(draft)
        if not system.rename(source, self._folder(f"batch-{batch_id:010d}_{'' if latest is None else latest}")[1]):
            raise RuntimeError(f"batch {batch_id} of {self.path} could not be published")


def keep_updates(
    stream: DataFrame,
    path: str,
    keys: Sequence[str],
    checkpoint: str | None = None,
    once: bool = True,
    fan_out: int = FAN_OUT,
) -> StreamingQuery:
    """Keep the changed rows of every micro-batch in an update log under `path`; `keys` name a row.

    `once` works off what has arrived and stops; otherwise the query keeps
    running. State lives in RocksDB, on disk, since it grows with the keys.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    log = UpdateLog(spark, path, keys, fan_out)

    def save(batch: DataFrame, batch_id: int) -> None:
        log.add(batch, batch_id)

    writer = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint"))
        .foreachBatch(save)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep_new(
    stream: DataFrame,
    path: str,
    checkpoint: str | None = None,
    once: bool = True,
    new: Callable[[DataFrame, ArrivalLog], DataFrame] | None = None,
) -> StreamingQuery:
    """Append the rows of a stream to a folder of files, each exactly once.

    With `new`, what it takes of each micro-batch, given the log of those before, is
    appended to an arrival log instead: ids need no state store, which takes some
    14 microseconds a row and a copy of every id.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    writer = stream.writeStream.outputMode("append").option(
        "checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint")
    )
    if once:
        writer = writer.trigger(availableNow=True)
    if new is None:
        return writer.format("parquet").start(path)
    log = ArrivalLog(spark, path)
    log.create()

    def save(batch: DataFrame, batch_id: int) -> None:
        log.add(batch, batch_id, new)

    return writer.foreachBatch(save).start()


def current_state(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The latest row of every key; no rows before the first batch."""
    return UpdateLog(spark, path, keys).state(schema)


def finish(query: StreamingQuery) -> None:
    """Wait for a query that was started once."""
    query.awaitTermination()
