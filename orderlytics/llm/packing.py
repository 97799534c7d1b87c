"""Best-fit packing planned over the histogram of lengths.

Documents are tokenized and cut into pieces of at most one sequence. The plan
only sees how many pieces each length has, at most one number per possible
length: best fit, longest lengths first, over counts, moving whole groups of
equally filled sequences at a time. Pieces then take their planned slots by
their rank within their length; ranks come from the task that cut the piece
plus how many pieces of that length earlier tasks have, so no length gathers
in one task.

A text that holds the string of a special token has that token's id there, as the
tokenizer gives it. NULL and empty texts are one piece that holds the end mark. Repeated rows are
packed each. No documents: no pieces.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from hashlib import md5
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlytics.llm.common import text_of
from orderlytics.session import cut_lineage

SEQUENCE = 1024
END_ID = 2
#: What a task remembers of texts it has encoded: pieces, or ids where these are kept.
MEMO_ENTRIES = 1 << 20
FLUSH_TOKENS = 1 << 20


class Encoder:
    """Ids as the tokenizer file gives them without adding special tokens.

    The merges come from the rank file of the same vocabulary, which is four
    times as fast; the special tokens from the tokenizer file: where a text
    holds the string of one, that is its id.
    """

    def __init__(self, ranks_path: str, tokenizer_path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(tokenizer_path, "rb") as whole:
            added = json.load(whole)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("special tokens that depend on what stands around them are not supported")
        self._made = tiktoken.Encoding(
            "ranks",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens={t["content"]: t["id"] for t in added},
        )

    def ids(self, text: str) -> np.ndarray:
        return self._made.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def cuts(n: int, size: int = SEQUENCE) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces: all full but the first."""
    start, length = 0, n % size or min(n, size)
    while start < n:
        yield start, length
        start, length = start + length, size


_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_RANK = "task int, nth bigint"
_IDS = "ids array<int>"


def _pieces(
    batches: Iterable[pa.RecordBatch], ranks_path: str, tokenizer_path: str, size: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    encode, end = Encoder(ranks_path, tokenizer_path).ids, np.array([END_ID], np.uint32)
    task, seen = TaskContext.get().partitionId(), Counter()
    known: dict[bytes, list[tuple]] = {}  # copies within a task are encoded once
    held, out = 0, []
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in f"{_PIECE}, {_RANK}".split(", ")]

    def flush() -> pa.RecordBatch:
        *columns, ids = list(zip(*out)) or [[] for _ in range(8)]
        made = [pa.array(c, k) for c, k in zip(columns, kinds)]
        if with_ids:
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        out.clear()
        return pa.RecordBatch.from_arrays(made, [*names, "ids"][: len(made)])

    for batch in batches:
        tokens = 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            name = md5(text.encode()).digest()
            if (own := known.get(name)) is None:
                ids = np.concatenate([encode(text), end])
                own = []
                for a, n in cuts(len(ids), size):
                    part = ids[a : a + n]
                    own.append((a, n, zlib.crc32(part.astype("<u4").tobytes()), part if with_ids else None))
                held += len(ids) if with_ids else len(own)
                if held >= MEMO_ENTRIES:
                    known.clear()
                    held = 0
                known[name] = own
            for k, (start, length, crc, part) in enumerate(own):
                out.append((doc, k, start, length, crc, task, seen[length], part))
                seen[length] += 1
                tokens += length
            if tokens >= FLUSH_TOKENS:
                yield flush()
                tokens = 0
        yield flush()


def pieces(
    docs: DataFrame, ranks_path: str, tokenizer_path: str, size: int = SEQUENCE, with_ids: bool = False
) -> DataFrame:
    """The pieces of all documents, tokenized once and written down; their ids too, if asked for."""
    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("body"))
    schema = f"{_PIECE}, {_RANK}" + (f", {_IDS}" if with_ids else "")
    return cut_lineage(rows.mapInArrow(lambda it: _pieces(it, ranks_path, tokenizer_path, size, with_ids), schema), "pieces")


class Slots(NamedTuple):
    """`n` sequences from `sequence` on, each with room at `offset` for a piece of `length`;
    they are for the pieces with ranks from `rank` on."""

    length: int
    rank: int
    n: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[Slots]:
    """Best fit, longest first, over {length: count}."""
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room left: how many, lengths inside
    rooms: list[int] = []

    def put(room: int, n: int, inside: tuple[int, ...]) -> None:
        if room not in groups or not groups[room]:
            insort(rooms, room)
        groups[room].append((n, inside))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = size // length
                if left >= each:
                    put(size - each * length, left // each, (length,) * each)
                if left % each:
                    put(size - left % each * length, 1, (length,) * (left % each))
                break
            room = rooms[at]
            n, inside = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            each = room // length  # the tightest sequence stays the tightest until it has no room for this length
            full = min(n, left // each)
            if full:
                put(room - each * length, full, inside + (length,) * each)
            left -= full * each
            if full < n:
                if 0 < left < each:
                    put(room - left * length, 1, inside + (length,) * left)
                    left, full = 0, full + 1
                if full < n:
                    put(room, n - full, inside)
    slots, ranks, sequence = [], Counter(), 0
    for room in rooms:
        for n, inside in groups[room]:
            offset = 0
            for length in inside:
                slots.append(Slots(length, ranks[length], n, sequence, offset))
                ranks[length] += n
                offset += length
            sequence += n
    return slots


_PLACED = "sequence_id bigint, offset bigint"


def _place(batches: Iterable[pa.RecordBatch], slots: list[Slots]) -> Iterator[pa.RecordBatch]:
    table = np.array(slots, np.int64).reshape(-1, 5)
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    bounds = np.searchsorted(table[:, 0], np.arange(table[-1, 0] + 2 if len(table) else 1))
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("nth").to_numpy() + batch.column("earlier").to_numpy()
        at = np.empty(len(length), np.int64)
        for value in np.unique(length):
            own = length == value
            first, last = bounds[value], bounds[value + 1]
            at[own] = first + np.searchsorted(table[first:last, 1], rank[own], "right") - 1
        sequence, offset = table[at, 3] + rank - table[at, 1], table[at, 4]
        kept = [n for n in batch.schema.names if n not in ("task", "nth", "earlier")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"]
        )


def packed(
    docs: DataFrame, ranks_path: str, tokenizer_path: str, size: int = SEQUENCE, with_ids: bool = False
) -> DataFrame:
    """One row per piece with its place, and its ids if asked for."""
    cut = pieces(docs, ranks_path, tokenizer_path, size, with_ids)
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    # A table, so that the join knows how few rows these are before it would shuffle the pieces with their ids.
    earlier = cut_lineage(earlier, "earlier-pieces")
    # At most `size` rows, however many documents there are.
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan(histogram, size)
    ranked = cut.join(earlier, ["length", "task"]).select(*cut.columns, "earlier")
    columns = f"{_PIECE}, {_IDS}" if with_ids else _PIECE
    return ranked.mapInArrow(lambda it: _place(it, slots), f"{columns}, {_PLACED}")


def sequences(placed: DataFrame) -> DataFrame:
    """The training sequences: one row (sequence_id, ids) per sequence, from pieces packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence holds a bounded number of ids
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
