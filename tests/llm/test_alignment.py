"""Merge-path alignment against a plain merge, and the whole operator against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orderlytics.llm import alignment

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("work", [1, 2, 3, 7, 50, 10_000])
@pytest.mark.parametrize("seed", range(4))
def test_pieces_give_the_shared_ends_and_equal_work(work, seed):
    rng = np.random.default_rng(seed)
    end = 1 + rng.integers(400)
    a, b = (np.union1d(rng.integers(1, end + 1, rng.integers(1, 300)), [end]) for _ in "ab")
    i, j = alignment.diagonals(a, b, work)
    assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b))
    each = np.diff(i) + np.diff(j)
    assert (np.abs(each[:-1] - work) <= 1).all() and each[-1] <= work + 1  # a tie is not parted
    assert all(max(a[:x], default=0) < min(b[y:], default=end + 1) for x, y in zip(i, j))
    assert all(max(b[:y], default=0) < min(a[x:], default=end + 1) for x, y in zip(i, j))
    x, y = alignment.stitched(a, b, work)
    assert a[x].tolist() == b[y].tolist() == np.intersect1d(a, b).tolist()


def test_one_side_without_tokens():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in alignment.stitched(none, none)] == [0, 0]


@pytest.mark.parametrize("step", [1, 2, 5, 1000])
def test_group_texts_in_steps(step):
    rng = np.random.default_rng(step)
    sizes = [0, 3, 0, 11, 1, 0, 20, 0]
    a_size, b_size = rng.integers(1, 5, sum(sizes)), rng.integers(1, 5, sum(sizes))
    a_ids, b_ids = rng.integers(0, 10 ** rng.integers(1, 6, a_size.sum())), rng.integers(0, 60_000, b_size.sum())
    a_last, b_last = np.cumsum(a_size) - 1, np.cumsum(b_size) - 1
    got = alignment.group_digests(a_ids, b_ids, a_last, b_last, np.cumsum(sizes), step)
    texts = [
        ",".join(map(str, a_ids[x - n + 1 : x + 1])) + "|" + ",".join(map(str, b_ids[y - m + 1 : y + 1]))
        for x, y, n, m in zip(a_last, b_last, a_size, b_size)
    ]
    ends = np.cumsum(sizes)
    want = [hashlib.sha256(";".join(texts[e - n : e]).encode()).hexdigest() for e, n in zip(ends, sizes)]
    assert got == want


def byte_of():
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def brute(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    value = byte_of()

    def piece(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    rows, count = [], Counter()
    for doc, text in docs:
        a = bpe.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        a_bytes = [bytes(value[c] for c in bpe.id_to_token(i)) for i in a]
        b_bytes = [piece(i) for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            rows.append((doc, 0, 0, [], ""))
            continue
        a_end = {e: k for k, e in enumerate(np.cumsum([len(x) for x in a_bytes]).tolist())}
        b_end = {e: k for k, e in enumerate(np.cumsum([len(x) for x in b_bytes]).tolist())}
        i = j = 0
        links, groups = [], []
        for e in sorted(a_end.keys() & b_end.keys()):
            x, y = a_end[e], b_end[e]
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            links.append((a[x], b[y]))
            i, j = x + 1, y + 1
        count.update(links)
        rows.append((doc, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(
        (
            (d, na, nb, len(ls), len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), sha)
            for d, na, nb, ls, sha in rows
        ),
        key=str,
    )


TEXTS = [
    None, "", " ", "  ", "a", "\n", "a\n\nb\tc  d ", "Überall dreimal Leer​zeichen", "é😀 日本語 \x00 \x7f",
    "a <|endoftext|> b <s></s><unk><0x41>", "▁ is not given back", "it's we'll I'M 12345 1234567890", "x" * 3000,
    "word " * 4000, "the the the", "the the the", "ﬁ Å é",
]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_brute_force(spark, docs, small, monkeypatch):
    """Also with pieces of five steps, and portions and blocks of a few documents."""
    if small:
        for name, value in (("WORK", 5), ("PORTION", 8), ("BLOCK_LINKS", 20)):
            monkeypatch.setattr(alignment, name, value)
        monkeypatch.setattr(alignment.stitched, "__defaults__", (5,))
    cases = [*enumerate(TEXTS), (None, "no id"), (4, "a"), (4, "other")]
    table = docs(*cases).select("*", *[F.lit("x").alias(n) for n in ("row", "body", "a", "block", "n", "spot", "docs")])
    found = alignment.aligned(table, RANKS, MODEL)
    assert {r.source for r in found.select("row.source").collect()} == {"src0"}
    columns = ["row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=str) == brute(cases)


def test_without_documents(docs):
    assert alignment.aligned(docs((1, "x")).limit(0), RANKS, MODEL).count() == 0
    assert alignment.aligned(docs((1, None), (2, "")).select("text"), RANKS, MODEL).select("n_a").collect() == [(0,), (0,)]
