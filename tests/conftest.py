from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from orderlytics.operators.changes import order_totals  # noqa: E402
from orderlytics.session import build_session  # noqa: E402
from orderlytics.sources.seed import rows_of, seed  # noqa: E402
from orderlytics.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_seed(spark) -> Tables:
    """The demonstration rows with the totals they were entered with."""
    return seed(spark)


@pytest.fixture(scope="session")
def shop(raw_seed) -> Tables:
    """The demonstration rows after order totals were recomputed."""
    return raw_seed.with_(orders=order_totals(raw_seed.orders, raw_seed.order_items))


@pytest.fixture
def make(spark):
    """Rows of a table with defaults filled in: `make("clients", "name, address", rows)`."""

    def build(table, columns, rows):
        return rows_of(spark, table, [c.strip() for c in columns.split(",")], rows)

    return build


@pytest.fixture
def empty(raw_seed) -> Tables:
    names = ("categories", "nomenclature", "clients", "orders", "order_items")
    return raw_seed.with_(**{n: getattr(raw_seed, n).limit(0) for n in names})
