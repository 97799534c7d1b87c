"""Request metrics over an event table or stream: counters, histogram, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.functions.measures import as_double

# The usual upper bounds of a latency histogram, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def windowed(events: DataFrame, width: str | None, lateness: str | None = None) -> tuple[DataFrame, list[Column]]:
    """Events with a watermark, and the grouping by time window (none without width)."""
    if lateness is not None:
        events = events.withWatermark("ts", lateness)
    return events, [F.window("ts", width)] if width else []


def event_counters(
    events: DataFrame, labels: Sequence[str], width: str | None = None, lateness: str | None = None
) -> DataFrame:
    """Events per label set and time window; the same call for a table or a stream."""
    rows, window = windowed(events, width, lateness)
    counts = rows.groupBy(*window, *labels).agg(F.count(F.lit(1)).alias("total"))
    start = [F.col("window.start").alias("window_start")] if width else []
    return counts.select(*start, *labels, "total")


def latency_histogram(
    events: DataFrame,
    labels: Sequence[str],
    value: str = "value",
    buckets: Sequence[float] = BUCKETS,
    width: str | None = None,
    lateness: str | None = None,
    summed: str | None = None,
) -> DataFrame:
    """Cumulative bucket counts with sum and count: one row per label set and bound.

    One pass counts all buckets at once; only the finished groups are unpivoted.
    The sum is taken in the type of `summed`, the column of the values unless
    given: over a decimal one the order of rows cannot change its last digit.
    """
    rows, window = windowed(events, width, lateness)
    measured = F.col(value)
    per_bucket = [F.count_if(measured <= bound).alias(f"_le{n}") for n, bound in enumerate(buckets)]
    amount = F.sum(summed or value).alias("sum")
    grouped = rows.groupBy(*window, *labels).agg(*per_bucket, F.count(value).alias("count"), amount)
    bounds = [
        F.struct(F.lit(float(bound)).alias("le"), F.col(f"_le{n}").alias("bucket_count"))
        for n, bound in enumerate(buckets)
    ]
    bounds.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("bucket_count")))
    start = [F.col("window.start").alias("window_start")] if width else []
    total = as_double(F.col("sum")).alias("sum")
    return grouped.select(*start, *labels, total, "count", F.inline(F.array(*bounds)))


def error_and_request_rate(
    events: DataFrame, is_error: Column | None = None, width: str | None = None, lateness: str | None = None
) -> DataFrame:
    """Requests, errors, seconds observed, errors per request and requests per second.

    Seconds and requests below 1 divide as 1.
    """
    error = F.col("event_type") == "error" if is_error is None else is_error
    rows, window = windowed(events, width, lateness)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    measured = rows.groupBy(*window).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(error).alias("errors"),
        F.coalesce(F.max(micros) - F.min(micros), F.lit(0)).alias("micros"),
    )
    seconds = F.col("micros") / 1e6
    start = [F.col("window.start").alias("window_start")] if width else []
    return measured.select(
        *start,
        "requests",
        "errors",
        seconds.alias("uptime_seconds"),
        (as_double(F.col("errors")) / F.greatest(as_double(F.col("requests")), F.lit(1.0))).alias("error_rate"),
        (as_double(F.col("requests")) / F.greatest(seconds, F.lit(1.0))).alias("requests_per_second"),
    )
