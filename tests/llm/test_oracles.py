"""Every text query that has SQL against that SQL on a second engine."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from orderlytics.llm.oracle import ORACLES  # noqa: E402
from orderlytics.llm.queries import QUERIES  # noqa: E402

duckdb = pytest.importorskip("duckdb")
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    engine = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        engine.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    theirs = engine.execute(ORACLES[name])
    columns = sorted(d[0] for d in theirs.description)
    order = [[d[0] for d in theirs.description].index(c) for c in columns]
    ours = QUERIES[name](spark, SMALL)
    assert sorted(ours.columns) == columns
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(map(key, (tuple(r) for r in ours.select(*columns).collect()))) == sorted(
        key([r[i] for i in order]) for r in theirs.fetchall()
    )
