"""Every named query against its SQL on a second engine."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from orderlytics.plans.oracle import ORACLES  # noqa: E402
from orderlytics.plans.queries import QUERIES  # noqa: E402

duckdb = pytest.importorskip("duckdb")

SMALL = "/root/testdata/sf0.001"
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in SOURCES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value))
    return str(value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(tuple(plain(r[n]) for n in order) for r in records)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, engine, name):
    ours = QUERIES[name](spark, SMALL)
    theirs = engine.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, theirs.fetchall())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
