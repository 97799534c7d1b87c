from __future__ import annotations

import pytest
from pyspark.sql import Row


@pytest.fixture
def docs(spark):
    """A `documents` table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0") for r in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], schema).repartition(3)

    return build
