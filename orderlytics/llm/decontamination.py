"""Benchmark decontamination by Wu-Manber search over words.

Every run of 13 words of a benchmark item is a pattern (an item with fewer
words is one). Patterns of one length share a table of shifts, indexed by a hash of
the last two words in view: a slot that no pattern leads to lets the search jump by
almost a whole pattern. Where the shift is zero, the bucket of patterns with the
hash of these two words and of the first one is looked up, and a direct comparison
of the words decides.

All tables are numpy arrays: some 30 bytes for each word of the items and the text
itself. They reach the tasks as a broadcast, in blocks of at most `BLOCK_BYTES` of
item text; a larger benchmark is searched block after block, with what was hit so
far carried in the rows, so neither the broadcast nor a worker grows with it.

NULL texts have no words and are never contaminated. A NULL item_id counts as
the empty string. Rows that repeat an item_id are parts of one item; repeated
documents are each judged. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlytics.llm.common import ROW, portions, text_of, wrapped
from orderlytics.llm.wordhash import Words, mixed, windows, words
from orderlytics.session import cut_lineage

WINDOW = 13
MIN_SHARE = 20  # contaminated: at least one word in twenty lies in a hit window
BLOCK_BYTES = 8 << 20

#: Bytes of UTF-8 as the search sees them: A-Z lowered, what lies between words a space.
_PLAIN = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _PLAIN[_low : _high + 1] = np.arange(_low, _high + 1)
_PLAIN[65:91] = np.arange(97, 123)


class _Table(NamedTuple):
    """Patterns of one length."""

    length: int
    block: int  # words that index the shifts
    shifts: np.ndarray  # by slot: how far the search may go on; 0 at the last words of a pattern
    keys: np.ndarray  # sorted; of each pattern, the hash of its last `block` words and its first
    starts: np.ndarray  # of each pattern, a place in the item words
    first: np.ndarray  # of each pattern, where its owners begin; one entry more
    owners: np.ndarray  # places in `names`


def _blocks(found: Words, size: int) -> np.ndarray:
    return found.hashes if size == 1 else windows(found, size)[0]


def _bucket(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(last * np.uint64(3) + first)


class WuManber:
    """Search of many word patterns: built from items, then `find` in the words of texts."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.names = sorted({item for item, _ in items})
        place = {name: n for n, name in enumerate(self.names)}
        owner = np.array([place[item] for item, _ in items], np.int32)
        pieces, texts, offset, n_words = [], [], 0, 0
        hashes, starts, ends, firsts = [], [], [], []
        for _, _, data, at in portions(pa.array([text for _, text in items], pa.large_binary()).cast(pa.large_string())):
            plain = _PLAIN[data]
            found = words(plain, at, lower=False)
            pieces.append(plain.tobytes())
            hashes.append(found.hashes)
            starts.append((found.starts + offset).astype(np.uint32))
            ends.append((found.ends + offset).astype(np.uint32))
            firsts.append(found.first[:-1] + n_words)
            offset, n_words = offset + len(plain), n_words + len(found.hashes)
        self.text = b"".join(pieces)
        self.starts, self.ends = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (starts, ends))
        first = np.append(np.concatenate(firsts) if firsts else np.zeros(0, np.int64), n_words).astype(np.int64)
        joined = Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), self.starts, self.ends, first)
        count = np.diff(first)
        self.tables = []
        for length in sorted({*count[(count > 0) & (count < window)].tolist(), *([window] if (count >= window).any() else [])}):
            if length == window:
                at = np.flatnonzero(windows(joined, window)[1]) if window > 1 else np.arange(n_words)
            else:
                at = first[:-1][count == length]
            whose = owner[np.searchsorted(first, at, "right") - 1]
            self.tables.append(_table(joined, at, whose, length))

    def find(self, plain: bytes, found: Words) -> Iterator[tuple[int, int, np.ndarray]]:
        """First word, word after the last, and owners of each occurrence; no text is left for the next."""
        for t in self.tables:
            if len(found.hashes) < t.length:
                continue
            blocks = _blocks(found, t.block)
            shifts = t.shifts[blocks & np.uint64(len(t.shifts) - 1)].tolist()
            ends = []  # where a pattern may end: its last word
            for begin, stop in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
                at, last = begin + t.length - t.block, stop - t.block
                while at <= last:
                    if shift := shifts[at]:
                        at += shift
                    else:
                        ends.append(at)
                        at += 1
            at = np.array(ends, np.int64)
            begins = at + t.block - t.length
            keys = _bucket(blocks[at], found.hashes[begins])
            low, high = np.searchsorted(t.keys, keys, "left"), np.searchsorted(t.keys, keys, "right")
            for n in np.flatnonzero(high > low).tolist():
                begin, end = int(begins[n]), int(begins[n]) + t.length
                seen = plain[found.starts[begin] : found.ends[end - 1]].split()
                for p in range(int(low[n]), int(high[n])):
                    place = int(t.starts[p])
                    if self.text[self.starts[place] : self.ends[place + t.length - 1]].split() == seen:
                        yield begin, end, t.owners[t.first[p] : t.first[p + 1]]


def _table(found: Words, at: np.ndarray, whose: np.ndarray, length: int) -> _Table:
    """`at`: the first words of the patterns; those with the same words become one with several owners."""
    block = min(2, length)
    hashes, blocks = found.hashes, _blocks(found, block)
    slots = 1 << max(10, int(4 * len(at)).bit_length())
    shifts = np.full(slots, length - block + 1, np.uint8 if length < 256 else np.uint32)
    for end in range(block, length + 1):  # shorter shifts come later and win
        shifts[blocks[at + end - block] & np.uint64(slots - 1)] = length - end
    keys = _bucket(blocks[at + length - block], hashes[at])
    whole = windows(found, length)[0][at] if length > 1 else hashes[at]
    order = np.lexsort((whose, whole, keys))
    at, whose, keys, whole = at[order], whose[order], keys[order], whole[order]
    new = np.ones(len(at), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (whole[1:] != whole[:-1])
    for k in range(length):
        new[1:] |= hashes[at[1:] + k] != hashes[at[:-1] + k]
    kept = new.copy()
    kept[1:] |= whose[1:] != whose[:-1]
    firsts = np.append(np.cumsum(kept)[new] - 1, kept.sum())
    return _Table(
        length, block, shifts, keys[new], at[new].astype(np.uint32), firsts.astype(np.uint32), whose[kept].astype(np.int32)
    )


_STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hits", T.BinaryType()),
    ]
)


def _search(batches: Iterator[pa.RecordBatch], matcher: WuManber, carried: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary()]
    for batch in batches:
        state = batch.column("state") if carried else None
        out: list[list] = [[], [], [], []]
        for low, high, data, at in portions(batch.column("body")):
            plain = _PLAIN[data]
            found = words(plain, at, lower=False)
            hit = np.zeros(len(found.hashes), np.uint8)
            owners: dict[int, set[str]] = defaultdict(set)
            for begin, end, whose in matcher.find(plain.tobytes(), found):
                hit[begin:end] = 1
                owners[int(np.searchsorted(found.first, begin, "right")) - 1].update(matcher.names[n] for n in whose.tolist())
            for i in range(high - low):
                begin, end = found.first[i : i + 2].tolist()
                old = state[low + i].as_py() if carried else None
                if old and old["hits"]:
                    hit[begin:end] |= np.unpackbits(np.frombuffer(old["hits"], np.uint8), count=end - begin)
                    owners[i].update(old["items"])
                here = hit[begin:end] if i in owners else hit[:0]
                for column, value in zip(
                    out,
                    (end - begin, int(here.sum()), sorted(owners.get(i, ())), np.packbits(here).tobytes() if len(here) else None),
                    strict=True,
                ):
                    column.append(value)
        made = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], [f.name for f in _STATE.fields])
        yield pa.RecordBatch.from_arrays([batch.column(ROW), made], [ROW, "state"])


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks whose text is within the bound, or a single item's."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.encode(text_of(), "UTF-8").alias("body"),
    )
    size = F.octet_length("body") + 64
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).head()[0]
    n = max(1, math.ceil(2 * total / block_bytes))
    place = F.pmod(F.xxhash64("item", "body"), F.lit(n))
    while n > 1:  # more blocks until each keeps the bound or holds equal items only
        place = F.pmod(F.xxhash64("item", "body"), F.lit(n))
        worst = items.distinct().groupBy(place.alias("b")).agg(F.sum(size).alias("s"), F.count("*").alias("k"))
        if worst.where(f"s > {block_bytes} and k > 1").isEmpty():
            break
        n *= 2
    for b in range(n):
        rows = items.distinct().where(place == b) if n > 1 else items.distinct()
        yield [(r.item, bytes(r.body)) for r in rows.collect()]


def searched(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Rows (wrapped) with n_words, n_hit, items (sorted ids) and `contaminated`."""
    context = docs.sparkSession.sparkContext
    rows, sent = docs.select(wrapped(docs)), None
    for items in blocks_of(benchmark, block_bytes):
        carried = sent is not None
        if carried and not items:
            continue
        if carried:
            rows = cut_lineage(rows, "searched")
            sent.destroy()
        sent = context.broadcast(WuManber(items, window))
        schema = T.StructType([rows.schema[ROW], T.StructField("state", _STATE)])
        # The text to search comes from the row itself, so that no round writes it twice.
        texts = rows.select("*", text_of(F.col(f"{ROW}.text")).alias("body"))
        rows = texts.mapInArrow(lambda it, m=sent, c=carried: _search(it, m.value, c), schema)
    state = F.col("state")
    hit, total = state["n_hit"], state["n_words"]
    return rows.select(
        ROW,
        total.alias("n_words"),
        hit.alias("n_hit"),
        state["items"].alias("items"),
        ((hit > 0) & (MIN_SHARE * hit >= total)).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
