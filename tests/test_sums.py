"""Totals of a stream with rows far behind its watermark equal one pass over all rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from helpers import tuples

from orderlytics.session import scratch_path
from orderlytics.streaming import metrics, sums
from orderlytics.streaming.state import current_state, finish, keep_updates

START = datetime(2024, 1, 1)
COUNTS = "window_start timestamp, event_type string, total bigint"


@pytest.fixture(scope="module")
def events(spark):
    kinds = ["view", "click", "error"]
    rows = [(START + timedelta(minutes=11 * n), kinds[n % 3]) for n in range(300)]
    return spark.createDataFrame(rows, "ts timestamp, event_type string")


def latest_first(spark, events, files=6):
    """One file per micro-batch, the youngest events in the first."""
    path = scratch_path(spark, "late-events")
    ordered = sorted(events.collect(), reverse=True)
    for n in range(files):
        part = spark.createDataFrame(ordered[n * len(ordered) // files : (n + 1) * len(ordered) // files], events.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_counters_of_late_rows(spark, events):
    keys = ["window_start", "event_type"]
    count = lambda batch: metrics.event_counters(batch, ["event_type"], "1 hour")
    path = scratch_path(spark, "sums")
    finish(sums.keep_sums(latest_first(spark, events), path, keys, {"total": "sum"}, count, fan_out=2))
    log = sums.SumLog(spark, path, keys, {"total": "sum"})
    assert sorted(tuples(log.state(COUNTS), *keys, "total")) == sorted(tuples(count(events)))
    assert max(p.level for p in log.parts()) > 0, "merges must have added up"

    closed = scratch_path(spark, "closed")
    watermarked = metrics.event_counters(latest_first(spark, events), ["event_type"], "1 hour", "1 hour")
    finish(keep_updates(watermarked, closed, keys))
    assert current_state(spark, closed, COUNTS, keys).count() < log.state(COUNTS).count(), "a watermark loses rows here"


def test_rates_of_late_rows_and_repeated_batches(spark, events):
    path = scratch_path(spark, "rates")
    totals = lambda batch: sums.request_totals(batch, "1 day")
    finish(sums.keep_sums(latest_first(spark, events), path, ["window_start"], sums.REQUEST_TOTALS, totals))
    log = sums.SumLog(spark, path, ["window_start"], sums.REQUEST_TOTALS)
    log.add(totals(events), 0)  # a repeated batch adds nothing
    found = sums.request_rates(log.state(sums.REQUEST_SCHEMA))
    assert sorted(tuples(found)) == sorted(tuples(metrics.error_and_request_rate(events, width="1 day")))


def test_before_the_first_batch(spark, tmp_path):
    log = sums.SumLog(spark, f"{tmp_path}/none", ["window_start"], sums.REQUEST_TOTALS)
    assert sums.request_rates(log.state(sums.REQUEST_SCHEMA)).count() == 0
