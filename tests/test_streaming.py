"""Streams over several files must end where one pass over all rows ends."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from orderlytics.operators.reports import client_order_summary
from orderlytics.session import scratch_path
from orderlytics.streaming import metrics
from orderlytics.streaming import orders as feeds
from orderlytics.streaming.state import ArrivalLog, UpdateLog, current_state, finish, keep_new, keep_updates

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    kinds = ["view", "click", "error", "view", "purchase"]
    rows = [(START + timedelta(minutes=7 * n), kinds[n % 5], (n * 37 % 100) / 8) for n in range(200)]
    return spark.createDataFrame(rows, "ts timestamp, event_type string, value double")


def as_stream(spark, df, order, files=4):
    """The rows in order, a few files at a time."""
    path = scratch_path(spark, "stream-input")
    df.repartitionByRange(files, order).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def work_off(spark, stream, keys):
    path = scratch_path(spark, "stream-state")
    query = keep_updates(stream, path, keys)
    finish(query)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    return current_state(spark, path, schema, keys), query


def test_counters(spark, events):
    table = metrics.event_counters(events, ["event_type"], "1 hour")
    # Files are read in no fixed order, so the watermark must cover the whole range.
    stream = metrics.event_counters(as_stream(spark, events, "ts"), ["event_type"], "1 hour", "7 days")
    state, query = work_off(spark, stream, ["window_start", "event_type"])
    assert sorted(tuples(state)) == sorted(tuples(table))
    assert len([p for p in query.recentProgress if p.numInputRows]) > 1
    assert sum(r.total for r in state.collect()) == 200


def test_histogram(spark, events):
    table = metrics.latency_histogram(events, ["event_type"])
    view = {r.le: r.bucket_count for r in table.where("event_type = 'view'").collect()}
    values = [r.value for r in events.where("event_type = 'view'").collect()]
    assert view == {le: sum(v <= le for v in values) for le in (*metrics.BUCKETS, float("inf"))}
    row = table.where("event_type = 'view'").first()
    assert (row["count"], row["sum"]) == (len(values), pytest.approx(sum(values)))
    events = events.withColumn("exact", F.col("value").cast("decimal(18,6)"))
    table = metrics.latency_histogram(events, ["event_type"], summed="exact")
    stream = metrics.latency_histogram(as_stream(spark, events, "ts"), ["event_type"], summed="exact")
    state, _ = work_off(spark, stream, ["event_type", "le"])
    assert sorted(tuples(state, *table.columns)) == sorted(tuples(table))


@pytest.mark.parametrize("values", [[2e12, 3e12], [4e-7, 4e-7, 4e-7]])
def test_histogram_sums_of_any_size(spark, values):
    rows = metrics.latency_histogram(spark.createDataFrame([("a", v) for v in values], "kind string, value double"), ["kind"])
    assert rows.first()["sum"] == pytest.approx(sum(values), rel=1e-12)


def test_rates(spark, events):
    row = metrics.error_and_request_rate(events).first()
    seconds = 199 * 7 * 60
    assert (row.requests, row.errors, row.uptime_seconds) == (200, 40, seconds)
    assert (row.error_rate, row.requests_per_second) == (0.2, 200 / seconds)
    nothing = metrics.error_and_request_rate(events.limit(0)).first()
    assert (nothing.requests, nothing.error_rate, nothing.requests_per_second) == (0, 0.0, 0.0)
    cache = metrics.event_counters(events.withColumn("cache_type", F.lit("redis")), ["cache_type", "event_type"])
    assert ("redis", "view", 80) in tuples(cache)


def test_order_totals_from_changes(spark, make, raw_seed):
    rows = [
        (1, "insert", 1, None, 10.0),
        (2, "insert", 1, None, 5.5),
        (3, "insert", 2, None, 7.0),
        (4, "update", 1, 10.0, 12.0),
        (5, "delete", 2, 7.0, None),
        (6, "insert", 3, None, 1.25),
        (7, "delete", 1, 5.5, None),
    ]
    feed = spark.createDataFrame(rows, "change_id bigint, op string, order_id bigint, old double, new double")
    feed = feed.select(
        "change_id", "op", "order_id", F.col("old").cast("decimal(12,2)").alias("old_total"), F.col("new").cast("decimal(12,2)").alias("new_total")
    )
    state, query = work_off(spark, feeds.order_total_changes(as_stream(spark, feed, "change_id")), ["order_id"])
    assert {r.order_id: (float(r.amount), r["items"]) for r in state.collect()} == {1: (12.0, 1), 2: (0.0, 0), 3: (1.25, 1)}
    assert len([p for p in query.recentProgress if p.numInputRows]) > 1


def test_repeated_deliveries_count_once(spark):
    rows = [(n // 2, START + timedelta(minutes=n // 2), "insert", 1) for n in range(10)]
    feed = spark.createDataFrame(rows, "change_id bigint, ts timestamp, op string, order_id bigint")
    feed = feed.withColumn("old_total", F.lit(None).cast("decimal(12,2)")).withColumn("new_total", F.lit(2).cast("decimal(12,2)"))
    path = scratch_path(spark, "deduplicated")
    finish(keep_new(feeds.unique_changes(as_stream(spark, feed, "ts"), "1 day"), path))
    assert sorted(tuples(spark.read.parquet(path), "change_id")) == [(n,) for n in range(5)]


TOLD = "seq int, id bigint, client_id bigint, status string, order_date timestamp"
CHANGE = "op string, order_id bigint, old_total decimal(12,2), new_total decimal(12,2)"


def fed(spark, told, changes, files=7):
    """Both feeds as one, a file at a time, its rows in an order of their own."""
    rows = [(*t, None, None, None, None) for t in told] + [(None,) * 5 + c for c in changes]
    feed = spark.createDataFrame(rows, f"{TOLD}, {CHANGE}")
    feed = feed.withColumn("place", F.xxhash64(*feed.columns))
    stream = as_stream(spark, feed, "place", files)
    return feeds.order_states(stream.where("seq IS NOT NULL"), stream.where("op IS NOT NULL"))


def test_client_summary_from_late_cancelling_and_shuffled_feeds(spark, shop):
    """Orders are told late, cancelled, revived and moved to another client; items come before and after."""
    orders, told = shop.orders.select("id", "client_id", "status", "order_date").collect(), []
    for n, r in enumerate(orders):
        if n % 3 == 0:
            told.append((1, r.id, r.client_id % 3 + 1, "new", r.order_date))
        if n % 2 == 0:
            told.append((2, r.id, r.client_id, "cancelled" if r.status != "cancelled" else "completed", r.order_date))
        told.append((3, r.id, r.client_id, r.status, r.order_date))
    changes = []
    for n, r in enumerate(shop.order_items.select("order_id", "total_price").collect()):
        changes.append(("insert", r.order_id, None, r.total_price))
        if n % 2:
            changes += [("update", r.order_id, r.total_price, 5 * r.total_price), ("update", r.order_id, 5 * r.total_price, r.total_price)]
        if n % 3 == 0:
            changes += [("insert", r.order_id, None, r.total_price), ("delete", r.order_id, r.total_price, None)]
    changes.append(("insert", 10_000, None, changes[0][3]))  # its order is never told
    state, query = work_off(spark, fed(spark, told, changes), ["order_id"])
    expected = client_order_summary(shop).withColumn("last_order", F.col("last_order").cast("timestamp_ntz"))
    assert sorted(tuples(feeds.client_summary(shop.clients, state))) == sorted(tuples(expected))
    assert len([p for p in query.recentProgress if p.numInputRows]) > 3


def test_amounts_wait_for_their_order_and_cancellations_take_them_back(spark):
    from decimal import Decimal

    day, ten = datetime(2024, 5, 1), Decimal("10.00")
    item = ("insert", 1, None, ten)
    assert tuples(work_off(spark, fed(spark, [], [item], 1), ["order_id"])[0]) == [(1, None, None, None, ten)]
    for told, counted in (([(1, 1, 7, "new", day)], 1), ([(2, 1, 7, "cancelled", day), (1, 1, 7, "new", day)], 0)):
        state, _ = work_off(spark, fed(spark, told, [item]), ["order_id"])
        assert tuples(feeds.client_sides(state)) == [(7, 1, day, ten)] * counted


def test_many_batches_leave_few_folders_and_whole_readers(spark, tmp_path):
    """200 batches; a reader that took its folders before merges still finds them."""
    log = UpdateLog(spark, f"{tmp_path}/log", ["id"], fan_out=4, keep=6)
    schema, want, before = "id bigint, total bigint", {}, None
    for batch in range(200):
        rows = [(batch % 13, batch), (100 + batch % 3, -batch), (1000 + batch, 1)]
        log.add(spark.createDataFrame(rows, schema).coalesce(1), batch)
        want.update(dict(rows))
        if batch == 61:  # the next batches merge three levels
            before, then = log.state(schema), dict(want)
        if batch == 64:
            assert dict(tuples(before)) == then
            log.add(spark.createDataFrame([(1, 10**6)], schema), 64)  # a repeated batch changes nothing
            log.add(spark.createDataFrame([(1, 10**6)], schema), 3)
    assert dict(tuples(log.state(schema))) == want
    assert len(log.parts()) <= 4 * 4
    assert len(list((tmp_path / "log").glob("level-*/*"))) <= 4 * 4 + 6 * 5  # replaced folders are gone
    assert len(list((tmp_path / "log" / "manifest").glob("[0-9]*"))) <= 6


def test_a_failed_merge_is_not_seen(spark, tmp_path, monkeypatch):
    log = UpdateLog(spark, f"{tmp_path}/log", ["id"], fan_out=2)
    schema = "id bigint, total bigint"
    log.add(spark.createDataFrame([(1, 1)], schema), 0)
    monkeypatch.setattr(log, "_publish", lambda parts: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        log.add(spark.createDataFrame([(1, 2), (2, 2)], schema), 1)
    monkeypatch.undo()
    assert tuples(log.state(schema)) == [(1, 1)]
    log.add(spark.createDataFrame([(1, 3)], schema), 1)
    assert tuples(log.state(schema)) == [(1, 3)] and [p.level for p in log.parts()] == [1]


def test_state_before_the_first_batch_is_empty(spark, tmp_path):
    from orderlytics.streaming.state import current_state

    state = current_state(spark, f"{tmp_path}/none", "id bigint, total double", ["id"])
    assert state.columns == ["id", "total"] and state.count() == 0


FEED = "change_id bigint, ts timestamp, op string, order_id bigint, old_total decimal(12,2), new_total decimal(12,2)"


def delivered(spark, *batches):
    """A stream with one file, and so one micro-batch, for each list of (change id, day of its time)."""
    path = scratch_path(spark, "deliveries")
    for batch in batches:
        rows = [(n, day and START + timedelta(days=day), "insert", 1, None, None) for n, day in batch]
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(path)


def unique_within(lateness):
    def new(batch, log):
        return feeds.unique_changes(batch, lateness, log.read(batch.select("change_id", "ts").schema), log.latest())

    return new


def test_repeated_deliveries_without_state(spark):
    """Copies in one batch and in later ones, late rows, ids told again after they expired: as the state store has it."""
    batches = [
        [(1, 100), (1, 100), (2, 101), (None, 101), (None, 101), (9, 60)],
        [(1, 100), (3, 101), (3, 103), (None, 102), (9, 102)],
        [(2, 130), (4, 131), (8, 80)],
        [(2, 130), (3, 101), (7, 95), (5, 125), (None, 131)],
        [(1, 131), (6, 119), (5, 125), (4, 130)],
        [(10, 200)],
        [(4, 200), (6, 199), (11, 150)],
        [(12, 201), (6, 190), (6, 189), (13, 189)],
    ]
    kept, by_state = scratch_path(spark, "kept"), scratch_path(spark, "by-state")
    query = keep_new(delivered(spark, *batches), kept, new=unique_within("10 days"))
    finish(query)
    assert len([p for p in query.recentProgress if p.numInputRows]) == len(batches)
    assert not any(p.stateOperators for p in query.recentProgress)
    finish(keep_new(feeds.unique_changes(delivered(spark, *batches), "10 days"), by_state))
    days = lambda df: sorted((r.change_id or 0, (r.ts - START).days) for r in df.select("change_id", "ts").collect())
    found = days(spark.read.option("recursiveFileLookup", "true").parquet(kept))
    by_id = lambda rows: [n for n, _ in rows]  # noqa: E731  # which of two deliveries in one batch is kept is open
    assert by_id(found) == by_id(days(spark.read.parquet(by_state)))
    assert [day for n, day in found if n == 1] == [100, 131], "an expired id counts again"
    assert (13, 189) not in found, "a late row"


def test_changes_without_a_time_are_not_forgotten(spark):
    path = scratch_path(spark, "kept")
    stream = delivered(spark, [(1, None), (2, 1)], [(1, None), (3, 100)], [(4, 200)], [(1, None), (2, 1), (5, None)])
    finish(keep_new(stream, path, new=unique_within("1 month 2 days 3 hours")))
    assert sorted(tuples(spark.read.option("recursiveFileLookup", "true").parquet(path), "change_id")) == [(n,) for n in (1, 2, 3, 4, 5)]


def test_empty_batches_and_batches_that_come_again(spark):
    log = ArrivalLog(spark, scratch_path(spark, "log"))
    rows = lambda *ids: spark.createDataFrame([(n, START, "insert", 1, None, None) for n in ids], FEED)
    new = unique_within("1 day")
    assert (log.latest(), log.read(rows().schema).count()) == (None, 0)
    log.add(rows(), 0, new)
    log.add(rows(1, 1, 2), 1, new)
    with pytest.raises(ZeroDivisionError):
        log.add(rows(3), 2, lambda batch, log: 1 / 0)
    rows(7).write.parquet(f"{log.path}/.draft-{2:010d}")  # left by an attempt that failed
    assert sorted(tuples(log.read(rows().schema), "change_id")) == [(1,), (2,)]
    log.add(rows(2, 3), 2, new)
    log.add(rows(), 3, new)
    log.add(rows(4), 1, new)
    assert sorted(tuples(log.read(rows().schema), "change_id")) == [(1,), (2,), (3,)]
    assert [n for n, _, _ in log.batches()] == [0, 1, 2, 3]
    assert log.latest() == int((START - datetime(1970, 1, 1)).total_seconds()) * 10**6


def test_the_repeated_feed_needs_no_state_of_its_ids(spark, tmp_path, monkeypatch):
    from pyarrow import parquet

    from orderlytics.plans import queries

    items = [(n // 4, n, 1, n % 4, 2.0, 10.0, "RAN"[n % 3]) for n in range(8_000)]
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(items, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    ran, paths = [], []
    monkeypatch.setattr(queries, "finish", lambda query: (query.awaitTermination(), ran.append(query)))
    monkeypatch.setattr(queries, "scratch_path", lambda spark, label: paths.append(scratch_path(spark, label)) or paths[-1])
    monkeypatch.setattr(queries, "FEED_BLOCK", 16 << 10)
    found = {r.order_id: (r.amount, r["items"]) for r in queries.stream_order_totals_repeated(spark, str(tmp_path)).collect()}
    want = {}
    for order, *_, flag in items:
        amount, count = want.get(order, (0.0, 0))
        want[order] = (amount + {"R": 0, "A": 2.0, "N": 10.0}[flag], count + (flag != "R"))
    assert found == want
    assert len([p for p in ran[0].recentProgress if p.numInputRows]) == 3
    assert not any(p.stateOperators for p in ran[0].recentProgress)
    files = [f for f in Path(paths[0].removeprefix("file:")).glob("*.parquet")]
    assert len(files) == 6 and min(parquet.ParquetFile(f).num_row_groups for f in files) > 1, "tasks share a file"
