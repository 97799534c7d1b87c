"""Totals of a stream in which no row is late.

A window that a watermark has closed drops what comes after. Counters, bucket
counts and extremes need no closing: what a micro-batch adds is aggregated by
itself and kept in a log whose merges add up instead of keeping the latest row.
No state is held in memory, a row counts however late it comes, and the totals
always equal those of one pass over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderlytics.functions.measures import as_double
from orderlytics.session import scratch_path
from orderlytics.streaming.state import BATCH, FAN_OUT, KEEP, UpdateLog

COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


class SumLog(UpdateLog):
    """An update log whose rows of one key add up; `totals` says how each value column does: sum, min or max."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: Sequence[str],
        totals: Mapping[str, str],
        fan_out: int = FAN_OUT,
        keep: int = KEEP,
    ) -> None:
        super().__init__(spark, path, keys, fan_out, keep)
        self.totals = dict(totals)

    def _merged(self, rows: DataFrame, keep_batch: bool = False) -> DataFrame:
        # A sum keeps its column's type, so that folders of all levels have one schema.
        values = [COMBINE[how](c).cast(rows.schema[c].dataType).alias(c) for c, how in self.totals.items()]
        if keep_batch:
            values.append(F.max(BATCH).alias(BATCH))
        return rows.groupBy(*self.keys).agg(*values).select(*rows.columns if keep_batch else [*self.keys, *self.totals])


def keep_sums(
    stream: DataFrame,
    path: str,
    keys: Sequence[str],
    totals: Mapping[str, str],
    summarise: Callable[[DataFrame], DataFrame],
    checkpoint: str | None = None,
    once: bool = True,
    fan_out: int = FAN_OUT,
) -> StreamingQuery:
    """Add what `summarise` makes of every micro-batch to the log under `path`; a repeated batch adds nothing."""
    spark = stream.sparkSession
    log = SumLog(spark, path, keys, totals, fan_out)

    def save(batch: DataFrame, batch_id: int) -> None:
        log.add(summarise(batch), batch_id)

    writer = stream.writeStream.option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint"))
    writer = writer.foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


REQUEST_TOTALS = {"requests": "sum", "errors": "sum", "first": "min", "last": "max"}
REQUEST_SCHEMA = "window_start timestamp, requests bigint, errors bigint, first bigint, last bigint"


def request_totals(events: DataFrame, width: str, is_error: Column | None = None) -> DataFrame:
    """Requests, errors, first and last microsecond per time window: parts that add up."""
    error = F.col("event_type") == "error" if is_error is None else is_error
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        events.groupBy(F.window("ts", width))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(error).alias("errors"),
            F.min(micros).alias("first"),
            F.max(micros).alias("last"),
        )
        .select(F.col("window.start").cast("timestamp").alias("window_start"), *REQUEST_TOTALS)
    )


def request_rates(totals: DataFrame) -> DataFrame:
    """Errors per request and requests per second from the totals; seconds below 1 divide as 1."""
    seconds = F.coalesce(F.col("last") - F.col("first"), F.lit(0)) / 1e6
    return totals.select(
        "window_start",
        "requests",
        "errors",
        seconds.alias("uptime_seconds"),
        (as_double(F.col("errors")) / F.greatest(as_double(F.col("requests")), F.lit(1.0))).alias("error_rate"),
        (as_double(F.col("requests")) / F.greatest(seconds, F.lit(1.0))).alias("requests_per_second"),
    )
