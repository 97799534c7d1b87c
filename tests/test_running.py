"""Running totals against brute force, with one group holding a third of the rows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from orderlytics.operators.running import POSITION, SLICE, numbered, placed, running, sliced


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for n in range(6000):
        group = 1 if n % 3 == 0 else rng.randrange(2, 300)
        rows.append((group, rng.randrange(10**6) * 10_000 + n, rng.randrange(-5, 50), rng.choice([None, rng.randrange(100)])))
    return rows, spark.createDataFrame(rows, "g bigint, o bigint, v bigint, w bigint").repartition(4)


@pytest.fixture
def many_slices(spark):
    """Keep small slices apart, as large ones are on a cluster."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_totals(skewed, many_slices):
    rows, df = skewed
    cut = sliced(df, ["g"], ["o"])
    result = running(cut, ["g"], ["o"], total=("sum", "v"), top=("max", "w"))
    sums, tops, expected = defaultdict(int), {}, set()
    for g, o, v, w in sorted(rows, key=lambda r: r[:2]):
        sums[g] += v
        if w is not None:
            tops[g] = max(tops.get(g, w), w)
        expected.add((g, o, v, w, sums[g], tops.get(g)))
    assert set(tuples(result, "g", "o", "v", "w", "total", "top")) == expected
    spread = dict(tuples(cut.groupBy("g").agg(F.countDistinct(SLICE))))
    assert spread[1] > 3, "the hot group must not sit in one slice"
    largest = cut.groupBy(SLICE).count().agg(F.max("count")).first()[0]
    assert largest < len(rows) / 6


def test_numbering(skewed, many_slices):
    rows, df = skewed
    seen = tuples(numbered(df, [F.desc("g"), "o"], "n"), "n", "g", "o")
    expected = sorted(((g, o) for g, o, *_ in rows), key=lambda r: (-r[0], r[1]))
    assert sorted(seen) == [(n, *row) for n, row in enumerate(expected, start=1)]


@pytest.mark.parametrize("heavy_rows", [0, 5, 10**6])
def test_positions_in_groups_of_any_size(skewed, many_slices, heavy_rows):
    """All groups by slices, the large ones only, and none."""
    rows, df = skewed
    seen = tuples(placed(df, ["g"], ["o"], total="size", heavy_rows=heavy_rows), "g", "o", POSITION, "size")
    places, expected = {}, []
    for g, o, *_ in sorted(rows, key=lambda r: r[:2]):
        expected.append((g, o, places.get(g, 0)))
        places[g] = places.get(g, 0) + 1
    assert sorted(seen) == [(g, o, place, places[g]) for g, o, place in expected]


def test_positions_and_a_join_share_one_shuffle(spark, skewed):
    _, df = skewed
    lines = placed(df, ["g"], ["o"], total="size")
    other = df.select("g").distinct().hint("merge")
    plan = lines.hint("merge").join(other, "g")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, "one for the lines, one for the other side"


def test_empty_input(spark):
    df = spark.createDataFrame([], "g bigint, o bigint, v bigint")
    assert running(sliced(df, ["g"], ["o"]), ["g"], ["o"], total=("sum", "v")).count() == 0
