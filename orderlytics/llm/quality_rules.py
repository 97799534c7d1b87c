"""Quality rules: per-document counts, and lines that too many documents of a host share.

Lines are normalised (A-Z lowered, blanks joined) and hashed. For each host the
documents of a line are counted; a document is a row, also where texts are equal.
A line is above the limit when at least `LINE_DOCS` documents of the host hold it,
however many the host has. Such lines are removed from the text, and a document is
rejected as depleted when they hold more than `DEPLETED` of its words.

NULL and empty texts have no words and fail the base rules. A NULL host is one
host. Repeated rows are judged each; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlytics.llm.common import BLANKS, ROW, portions, text_of, wrapped
from orderlytics.llm.wordhash import Words, mixed, windows, words
from orderlytics.session import cut_lineage

LINE_DOCS = 20
DEPLETED = 0.5
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
NAME = ["name_a", "name_b"]
COUNTED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "kept_text"]


def _per_text(flags: np.ndarray, texts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[texts[1:]] - total[texts[:-1]]


def _repeated(found: Words) -> list[int]:
    """Per text, its words in windows of three words that it has twice or more."""
    hashes, _ = windows(found, 3)
    out = []
    for first, last in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        own = hashes[first : max(first, last - 2)]
        s = np.sort(own)
        twice = s[1:][s[1:] == s[:-1]]
        if not len(twice):
            out.append(0)
            continue
        hit = np.isin(own, twice)
        covered = np.zeros(last - first, bool)
        for k in range(3):
            covered[k : k + len(hit)] |= hit
        out.append(int(covered.sum()))
    return out


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _ordered_sum(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash for each run of words; `starts` and `counts` of the non-empty runs."""
    nth = np.arange(len(hashes)) - np.repeat(starts, counts)
    with np.errstate(over="ignore"):
        return np.add.reduceat(mixed(hashes + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts)


class Lines(NamedTuple):
    hashes: np.ndarray  # one for each line, 0 without words
    words: np.ndarray
    first: np.ndarray  # per text: its first line; one entry more than texts


def _lines(data: np.ndarray, texts: np.ndarray) -> Lines:
    """Lines of each text, but for an empty one at its end."""
    low = words(data, texts, lower=True)
    starts = np.unique(np.concatenate([texts[:-1], np.flatnonzero(data == 10) + 1]))
    bounds = np.searchsorted(low.starts, np.append(starts, len(data)))
    held = np.diff(bounds)
    full = held > 0
    hashes = np.zeros(len(held), np.uint64)
    if full.any():
        hashes[full] = _ordered_sum(low.hashes, bounds[:-1][full], held[full])
    of = np.searchsorted(texts, starts, "right") - 1
    return Lines(hashes.view(np.int64), held, np.searchsorted(of, np.arange(len(texts))))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row the hashes of its lines that have words, each once."""
    for batch in batches:
        made: list[np.ndarray] = []
        for _, _, data, texts in portions(batch.column("body")):
            found = _lines(data, texts)
            for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
                made.append(np.unique(found.hashes[a:b][found.words[a:b] > 0]))
        names = [*NAME, "host"]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, names), pa.array(made, pa.list_(pa.int64()))], [*names, "lines"]
        )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its counts, and its text without the lines in `gone`."""
    for batch in batches:
        made: list[list] = [[] for _ in range(7)]
        gone = batch.column("gone")
        for first, last, data, texts in portions(batch.column("body")):
            raw, found = words(data, texts, lower=False), _lines(data, texts)
            blank = (data == 32) | ((data >= 9) & (data <= 13))
            bodies = batch.column("body").slice(first, last - first).to_pylist()
            made[0] += np.diff(raw.first).tolist()
            made[1] += _per_text(~blank & ((data & 0xC0) != 0x80), texts).tolist()
            made[2] += _per_text(_SYMBOL[data], texts).tolist()
            made[3] += [_duplicate_lines(t) for t in bodies]
            made[4] += _repeated(raw)
            for body, a, b, own in zip(bodies, found.first[:-1], found.first[1:], gone.slice(first, last - first)):
                if not own.is_valid:
                    made[5].append(0)
                    made[6].append(body)
                    continue
                out = np.isin(found.hashes[a:b], own.values.to_numpy()) & (found.words[a:b] > 0)
                made[5].append(int(found.words[a:b][out].sum()))
                kept = [x for x, cut in zip_longest(body.split("\n"), out.tolist(), fillvalue=False) if not cut]
                made[6].append("\n".join(kept))
        verdict = pa.StructArray.from_arrays([*(pa.array(m, pa.int64()) for m in made[:6]), pa.array(made[6], pa.string())], COUNTED)
        yield pa.RecordBatch.from_arrays([batch.column(ROW), verdict], [ROW, "found"])


def judged(docs: DataFrame, text: str = "text", host: str = "source", id: str = "doc_id") -> DataFrame:
    """Rows (wrapped) with `doc_id`, counts, `base_failed`, words in removed lines, `kept`, and
    `kept_text`: the text without the lines above the limit, also of documents that are not kept.

    Counting works on hashes and is combined on the map side; only lines above the
    limit are joined back. The text is shuffled once, by row, to meet its lines.
    """
    place = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    # Rows with equal id, host and text lose equal lines, so this serves as their name.
    told = [F.coalesce(F.col(id).cast("string"), F.lit("")), place, text_of(text)]
    name = [F.xxhash64(*told).alias(NAME[0]), F.xxhash64(F.lit("row"), *told).alias(NAME[1])]
    body = docs.select(*name, place.alias("host"), text_of(text).alias("body"))
    hashed = body.mapInArrow(_hashed, "name_a bigint, name_b bigint, host string, lines array<bigint>")
    hashed = cut_lineage(hashed, "line-hashes")

    lines = hashed.select(*NAME, "host", F.explode("lines").alias("line"))
    docs_of = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    above = cut_lineage(docs_of.where(F.col("docs") >= LINE_DOCS).select("host", "line"), "lines-above")
    gone = lines.join(above, ["host", "line"]).groupBy(*NAME).agg(F.collect_set("line").alias("gone"))
    joined = docs.select(wrapped(docs), *name).join(gone.hint("shuffle_hash"), NAME, "left")
    ready = joined.select(ROW, text_of(f"{ROW}.`{text}`").alias("body"), "gone")
    kinds = [T.StructField(c, T.LongType()) for c in COUNTED[:-1]] + [T.StructField(COUNTED[-1], T.StringType())]
    found = ready.mapInArrow(_measure, T.StructType([ready.schema[ROW], T.StructField("found", T.StructType(kinds))]))
    found = found.select(ROW, F.col(f"{ROW}.`{id}`").cast("bigint").alias("doc_id"), "found.*")
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n)
    out = found.select(ROW, "doc_id", *COUNTED[:-2], failed.alias("base_failed"), "removed_words", "kept_text")
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("removed_words") > DEPLETED * n))
