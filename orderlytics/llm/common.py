"""Expressions and small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The characters between words: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"

ROW = "row"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts without other letters take the fast way."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_of(column: str | Column = "text") -> Column:
    """The text, a missing one being empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def wrapped(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that no working column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)


def unwrapped(df: DataFrame, schema, **changed: Column) -> DataFrame:
    """The columns of the wrapped rows again, some of them replaced."""
    return df.select(*[changed.get(f.name, F.col(f"{ROW}.`{f.name}`")).alias(f.name) for f in schema.fields])


def batches(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    """`n` disjoint batches that together hold every row; rows with an equal key stay together."""
    place = F.pmod(F.xxhash64(key), F.lit(n))
    return [df.where(place == k) for k in range(n)]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column one after another, and where each begins; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def portions(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about `size` bytes: first row, row after the last, bytes, starts.

    Working arrays take some 40 bytes for each byte of text, so memory stays
    bounded by the portion, or by the longest text.
    """
    data, starts = flat(column)
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
        first = last
