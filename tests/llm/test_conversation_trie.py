"""The prefix trie against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orderlytics.llm import conversation_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows, family=5, heads=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = tuple(own.get(c - c % family, [])[:h] + ts[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), parent, len(m), len(children[p]), leaves[p], saved[p], sha))
    return sorted(out, key=str)


def built(df, max_cells=trie.MAX_CELLS, family=5, heads=9):
    prefixes, convs = trie.spliced(trie.turns(df), family, heads)
    return sorted((tuple(r) for r in trie.trie(prefixes, convs, max_cells).collect()), key=str)


def cases():
    rows = [(c, t, "user" if t % 2 else None, f"same {t} é") for c in range(0, 40) for t in range(c % 7 + 1)]
    rows += [(100 + c, t, "user", f"own {c} {t}") for c in range(30) for t in range(9 + c)]
    rows += [(200 + c, 0, "user", "alone") for c in range(20)]
    rows += [(203, None, "user", "before"), (203, None, "user", "also before"), (203, 0, "user", "alone"), (204, 0, "user", "alone")]
    rows += [(210, 5, None, None), (211, 5, "", ""), (212, None, None, None), (None, 0, "user", "nobody"), (-3, 0, "a", "b"), (-5, 0, "a", "b")]
    rows += [(500 + c, t, "user", f"long {t}") for c in (0, 5) for t in range(300)]
    return rows


@pytest.mark.parametrize("max_cells", [trie.MAX_CELLS, 16, 256])
def test_trie_equals_brute_force(spark, max_cells, monkeypatch):
    """With few cells the sketch proves little, and rows below a proof come along."""
    if max_cells < trie.PART:
        monkeypatch.setattr(trie, "PART", max_cells)
    df = spark.createDataFrame(cases(), SCHEMA).repartition(5)
    extra = df.select("*", *[F.lit("x").alias(n) for n in ("conv", "nth", "digest", "depth", "key_a", "n", "last", "_slice", "h")])
    assert built(extra, max_cells) == brute(cases())


def test_sketch_never_proves_a_shared_prefix(spark):
    prefixes, convs = trie.spliced(trie.turns(spark.createDataFrame(cases(), SCHEMA)), 5, 9)
    names = prefixes.select(*trie.KEY).toPandas()
    counts = trie.sketch(prefixes, len(names))
    least = None
    for at in trie._cells(names["key_a"].to_numpy(), names["key_b"].to_numpy(), len(counts)):
        least = counts[at] if least is None else least.clip(max=counts[at])
    shared = names.duplicated(keep=False).to_numpy()
    assert (least[shared] == 2).all() and (least[~shared] == 1).mean() > 0.9


def test_long_hot_and_turnless(spark, monkeypatch):
    """One conversation holds most rows, copies share an end beyond one chunk, and some lose all turns."""
    monkeypatch.setattr(trie, "CHUNK", 64)
    rows = [(1000, t, "user", f"t{t % 3}") for t in range(300)] + [(c, 0, "user", "copy") for c in range(1, 400, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert built(df) == brute(rows)
    assert built(df, family=1, heads=1) == brute(rows, 1, 1)


def test_without_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert built(df) == []
    assert built(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
    only = [(6, 0, "a", "b")]  # conversation 5 is absent and the own turn is cut
    assert built(spark.createDataFrame(only, SCHEMA)) == brute(only)


def test_nodes_with_their_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "user", "hi"), (2, 1, "bot", "no"), (2, 2, "bot", "no")]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = trie.trie(*trie.spliced(trie.turns(df)))
    got = {(r.conv_id, r.depth): (r.role, r.text, r.n_convs) for r in trie.with_turns(nodes, df).collect()}
    assert got == {
        (1, 0): (None, None, 2),
        (1, 1): ("user", "hi", 2),
        (1, 2): ("bot", "yes", 1),
        (2, 2): ("bot", "no", 1),
        (2, 3): ("bot", "no", 1),
    }
