"""Alignment of two tokenizers' tokens by merge-path partitioning.

Both tokenizers give sorted byte offsets at which their tokens end. Offsets of
all texts of a portion are laid one behind the other, and merging the two lists
is cut by binary searches on the diagonals of their merge path into pieces of
equal work, whatever the lengths of the texts. Pieces are merged independently
of each other; each gives the ends that both lists share and the tokens that
are left open at its borders. Stitching the open tokens of neighbours gives the
groups: the shortest runs of tokens on both sides that cover the same bytes.

Tokens stay in the task that made them. What leaves it are blocks of documents
with about `BLOCK_LINKS` links: counts of the linked id pairs of the block, and
for each document which of these it holds, how often. Pair counts are summed
over the corpus in one shuffle with at most one row per pair and block, and come
back to the block in the same form; no link is ever a row.

A text that is NULL, empty, or not given back byte for byte by the tokens of
either tokenizer has no tokens: all its numbers are 0 and its group digest is
empty. Repeated rows count each. No documents: no rows. Other columns, whatever
their names, come along in `row`.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlytics.llm.common import ROW
from orderlytics.session import cut_lineage

#: Merge steps in a piece.
WORK = 1 << 15
#: Links after which a block of documents is closed, and text bytes after which a portion is merged.
BLOCK_LINKS, PORTION = 1 << 20, 1 << 20


# --- tokenizers


class Bpe:
    """Byte-level BPE from a rank file; the strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, number in ranks.items():
            self.sizes[number] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return self._made.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int32)

    def joined(self, ids: np.ndarray) -> bytes:
        return self._made.decode_bytes(ids.tolist())


class Pieces:
    """Sentence pieces, which put the space before the text themselves."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._made = sentencepiece.SentencePieceProcessor(model_file=path)
        self._bytes = [self._piece(i) for i in range(self._made.get_piece_size())]
        self.sizes = np.array([len(p) for p in self._bytes], np.int64)

    def _piece(self, number: int) -> bytes:
        piece = self._made.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self._made.is_byte(number) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._made.encode(text, num_threads=1), np.int32)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))


@cache
def _tokenizers(ranks_path: str, model_path: str) -> tuple[Bpe, Pieces]:
    return Bpe(ranks_path), Pieces(model_path)


# --- merging


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of `work` merge steps begin in `a` and `b`, sorted without repeats.

    Binary search on each diagonal, all at once: in the merge, with `a` first on
    ties, the first `step` elements are i of `a` and step - i of `b`. A tie that
    a diagonal would part stays with the piece before it.
    """
    steps = np.arange(0, len(a) + len(b) + work, work)
    steps[-1] = len(a) + len(b)
    low, high = np.maximum(steps - len(b), 0), np.minimum(steps, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # One more of `a` belongs to the first elements if it is no larger than the last of `b` among them.
        other = steps - mid - 1
        more = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(other, 0, len(b) - 1)]) & (other >= 0)
        low, high = np.where(more, mid + 1, low), np.where(open_ & ~more, mid, high)
    i, j = low, steps - low
    parted = (i > 0) & (j < len(b))
    parted[parted] = a[i[parted] - 1] == b[j[parted]]
    return i, j + parted


def overlaps(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the ends that both sides of a piece share; the piece begins at i and j."""
    at = np.searchsorted(b, a)
    inside = at < len(b)
    inside[inside] = b[at[inside]] == a[inside]
    return i + np.flatnonzero(inside), j + at[inside]


def stitched(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Last token of every group on both sides. Tokens that a piece leaves open
    belong to the group that the next shared end closes, in whichever piece."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = diagonals(a, b, work)
    each = [overlaps(a[i0:i1], b[j0:j1], i0, j0) for i0, i1, j0, j1 in zip(i, i[1:], j, j[1:])]
    return np.concatenate([x for x, _ in each]), np.concatenate([y for _, y in each])


_DIGITS = 10


def _listed(a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> np.ndarray:
    """The groups as text, `a1,a2|b1;...;`, in bytes; and where each group's text ends."""
    na, nb = a_last + 1, b_last + 1
    a_size, b_size = np.diff(na, prepend=0), np.diff(nb, prepend=0)
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    ids[np.arange(len(a_ids)) + np.repeat(nb - b_size, a_size)] = a_ids
    ids[np.arange(len(b_ids)) + np.repeat(na, b_size)] = b_ids
    mark[na + (nb - b_size) - 1] = ord("|")
    mark[na + nb - 1] = ord(";")
    digits = np.ones(len(ids), np.int64)
    for power in range(1, _DIGITS):
        if not (more := ids >= 10**power).any():
            break
        digits += more
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]), np.uint8)
    out[ends - 1] = mark
    rest, at = ids.copy(), ends - 2
    left = np.arange(len(ids))
    for _ in range(_DIGITS):
        out[at[left]] = ord("0") + rest[left] % 10
        rest[left] //= 10
        at[left] -= 1
        left = left[rest[left] > 0]
        if not len(left):
            break
    return out, ends[na + nb - 1]


def group_digests(
    a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, docs: np.ndarray, step: int = 1 << 17
) -> list[str]:
    """SHA-256 of the groups of each document, written some groups at a time; `docs` has the group count up to each."""
    states, doc = [hashlib.sha256() for _ in docs], 0
    for first in range(0, len(a_last), step):
        last = min(first + step, len(a_last))
        i, j = (0, 0) if not first else (a_last[first - 1] + 1, b_last[first - 1] + 1)
        text, ends = _listed(
            a_ids[i : a_last[last - 1] + 1], b_ids[j : b_last[last - 1] + 1], a_last[first:last] - i, b_last[first:last] - j
        )
        begin = 0
        while doc < len(docs):
            upto = min(docs[doc], last) - first
            end = int(ends[upto - 1]) if upto else 0
            closed = docs[doc] <= last
            if end > begin:
                states[doc].update(text[begin : end - closed])
            begin = end
            if not closed:
                break
            doc += 1
    return [s.hexdigest() for s in states]


# --- documents and blocks

_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_DOC = T.StructType(
    [*[T.StructField(n, T.LongType()) for n in _NUMBERS], T.StructField("groups_sha256", T.StringType())]
    + [T.StructField("spots", T.IntegerType())]
)
_INTS = T.ArrayType(T.IntegerType())


def _block_schema(row: T.DataType) -> T.StructType:
    doc = T.StructType([T.StructField(ROW, row), *_DOC.fields])
    ints = [T.StructField(n, _INTS) for n in ("spot", "times", "a", "b", "n")]
    return T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(doc)), *ints])


class _Block:
    """Documents that belong together, and the linked pairs they hold."""

    def __init__(self) -> None:
        self.docs, self.columns, self.pairs, self.spots, self.links = [], [], [], [], 0

    def table(self, number: int, row_type: pa.DataType) -> pa.RecordBatch:
        pairs = np.concatenate(self.pairs) if self.pairs else np.zeros(0, np.int64)
        times = np.concatenate(self.spots) if self.spots else np.zeros(0, np.int64)
        known, spot = np.unique(pairs, return_inverse=True)
        total = np.bincount(spot, weights=times, minlength=len(known)).astype(np.int64)
        fields = [pa.concat_arrays(self.docs)] + [pa.array(c) for c in zip(*self.columns)]
        docs = pa.StructArray.from_arrays(
            [fields[0]] + [f.cast(k) for f, k in zip(fields[1:], [pa.int64()] * 4 + [pa.string(), pa.int32()])],
            [ROW, *(f.name for f in _DOC.fields)],
        )
        lists = [spot, times, known >> 32, known & 0xFFFFFFFF, total]
        columns = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)]
        columns += [
            pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32))) for x in lists
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "docs", "spot", "times", "a", "b", "n"])


def _blocks(batches: Iterable[pa.RecordBatch], ranks_path: str, model_path: str) -> Iterator[pa.RecordBatch]:
    bpe, pieces = _tokenizers(ranks_path, model_path)
    task, number, block = TaskContext.get().partitionId(), 0, _Block()

    def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        if text:
            whole = b" " + text.encode()
            a, b = bpe.ids(text), pieces.ids(text)
            if bpe.joined(a) == whole and pieces.joined(b) == whole:
                return a, b, len(whole)
        return np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def merged(rows: pa.Array, found: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """The documents of a portion go into the block."""
        a_ids, b_ids = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        # Token sizes add up to the texts' lengths, so sums over all texts are offsets in the whole portion.
        a_last, b_last = stitched(np.cumsum(bpe.sizes[a_ids]), np.cumsum(pieces.sizes[b_ids]))
        a_end, b_end = (np.cumsum([len(f[k]) for f in found]) for k in (0, 1))
        upto = np.searchsorted(a_last, a_end)  # groups up to the end of each document
        digests = group_digests(a_ids, b_ids, a_last, b_last, upto)
        linked = (a_ids[a_last].astype(np.int64) << 32) | b_ids[b_last]
        block.docs.append(rows)
        first = 0
        for k, (a, b, _) in enumerate(found):
            pairs, times = np.unique(linked[first : upto[k]], return_counts=True)
            n = int(upto[k]) - first
            block.pairs.append(pairs)
            block.spots.append(times)
            block.columns.append((len(a), len(b), n, n, digests[k] if len(a) else "", len(pairs)))
            block.links += n
            first = int(upto[k])

    row_type = None
    for batch in batches:
        rows, texts = batch.column(0), batch.column(1)
        row_type, first, found, size = rows.type, 0, [], 0
        for at, text in enumerate(texts):
            found.append(tokens(text.as_py()))
            size += found[-1][2]
            if size >= PORTION or at + 1 == len(texts):
                merged(rows.slice(first, at + 1 - first), found)
                first, found, size = at + 1, [], 0
                if block.links >= BLOCK_LINKS:
                    yield block.table((task << 32) | number, row_type)
                    number, block = number + 1, _Block()
    if block.docs:
        yield block.table((task << 32) | number, row_type)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of joined blocks with the corpus-wide counts of their links."""
    for batch in batches:
        for k in range(batch.num_rows):
            docs = batch.column("docs")[k].values
            spot, times = (batch.column(c)[k].values.to_numpy() for c in ("spot", "times"))
            if batch.column("known")[k].is_valid:
                known = batch.column("known")[k].values
                count = np.zeros(len(batch.column("a")[k]), np.int64)
                best = np.zeros(len(count), np.int64)
                place = known.field("place").to_numpy()
                count[place], best[place] = known.field("count").to_numpy(), known.field("best").to_numpy(zero_copy_only=False)
            else:
                count = best = np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(docs.field("spots").to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(x[spot] * times)]) for x in (best, count)]
            best_of, sum_of = (s[ends[1:]] - s[ends[:-1]] for s in sums)
            names = [ROW, *_NUMBERS, "groups_sha256"]
            columns = [docs.field(n) for n in names] + [pa.array(best_of), pa.array(sum_of)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_best", "count_sum"])


def aligned(docs: DataFrame, ranks_path: str, model_path: str, text: str = "text") -> DataFrame:
    """One row per document: `row` (its other columns), n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.struct(*others).alias(ROW), F.col(text).alias("body"))
    row_type = rows.schema[ROW].dataType
    blocks = rows.mapInArrow(lambda it: _blocks(it, ranks_path, model_path), _block_schema(row_type))
    blocks = cut_lineage(blocks, "aligned-blocks")
    held = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "pair"))
    held = held.select("block", "place", "pair.a", "pair.b", "pair.n")
    counts = cut_lineage(pair_counts(held), "pair-counts")
    known = held.join(counts, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("known"))
    joined = blocks.join(known, "block", "left").select("docs", "spot", "times", "a", "known")
    numbers = [T.StructField(n, T.LongType()) for n in _NUMBERS]
    tail = [T.StructField(n, T.LongType()) for n in ("n_best", "count_sum")]
    schema = T.StructType(
        [T.StructField(ROW, row_type), *numbers, T.StructField("groups_sha256", T.StringType()), *tail]
    )
    return joined.mapInArrow(_counted, schema)


def pair_counts(held: DataFrame) -> DataFrame:
    """Links of each id pair over the corpus, and whether no pair of its B id has more."""
    counts = held.groupBy("a", "b").agg(F.sum(F.col("n").cast("bigint")).alias("count"))
    counts = cut_lineage(counts, "links")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
