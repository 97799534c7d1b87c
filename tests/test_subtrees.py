from __future__ import annotations

import random

import pytest
from helpers import tuples

from orderlytics.operators import hierarchy
from orderlytics.operators.changes import delete_subtree
from orderlytics.operators.subtrees import SubtreeIndex, cycle_nodes

COLUMNS = ("ancestor_id", "descendant_id", "distance")


def nodes_of(spark, parents):
    return spark.createDataFrame(list(parents.items()), "id bigint, parent_id bigint")


def brute(parents, given):
    """Pairs by walking up from every node until a node repeats."""
    found = {}
    for node in parents:
        at, distance, seen = node, 0, set()
        while at in parents and at not in seen:
            seen.add(at)
            if at in given:
                found[at, node] = distance
            at, distance = parents[at], distance + 1
    return sorted((a, d, n) for (a, d), n in found.items())


@pytest.mark.parametrize("seed", range(2))
def test_intervals_equal_walks_up_on_broken_trees(spark, tmp_path, seed):
    rng = random.Random(seed)
    # Parents among all ids make cycles with trees on them; 900 is no node; some point at themselves.
    parents = {n: rng.choice([None, 900, n, rng.randrange(400), *[rng.randrange(max(n, 1))] * 9]) for n in range(400)}
    tree = nodes_of(spark, parents)
    index = SubtreeIndex.build(tree, str(tmp_path / "index"))
    given = [*rng.sample(range(400), 150), 5000]
    ids = spark.createDataFrame([(n,) for n in [*given, given[0]]], "id bigint")
    got = sorted(tuples(index.below(ids), *COLUMNS))
    assert got == brute(parents, set(given)) == sorted(tuples(hierarchy.below(tree, ids), *COLUMNS))
    loops = {n for n in parents if any(a == n for a in ancestors(parents, n))}
    assert {r.id for r in cycle_nodes(tree).collect()} == loops
    sizes = {r.id: r.n_below for r in SubtreeIndex(spark, index.folder).sizes().collect()}
    assert set(sizes) == set(parents) - loops
    everything = brute(parents, set(parents))
    assert all(sizes[n] == sum(a == n for a, _, _ in everything) - 1 for n in sizes)


def ancestors(parents, node):
    seen, at = set(), parents[node]
    while at in parents and at not in seen:
        seen.add(at)
        yield at
        at = parents[at]


def test_deep_chain_and_wide_family_in_few_rounds(spark, tmp_path):
    parents = {1: None, **{n: n - 1 for n in range(2, 2001)}, **{n: 1000 for n in range(3000, 6000)}}
    index = SubtreeIndex.build(nodes_of(spark, parents), str(tmp_path / "index"))
    rows = {r.id: r for r in index.nodes().where("id IN (1, 1000, 2000, 3000)").collect()}
    assert (rows[1].depth, rows[1].top, rows[1].under, rows[2000].depth) == (0, 5000, 0, 1999)
    assert (rows[3000].depth, rows[3000].root_id, rows[1000].top - rows[1000].under) == (1000, 1, 4001)
    below = index.below(spark.createDataFrame([(1000,), (1999,)], "id bigint"))
    assert below.count() == 4001 + 2
    text = below._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_empty_table(spark, tmp_path):
    index = SubtreeIndex.build(nodes_of(spark, {1: None}).limit(0), str(tmp_path / "index"))
    assert index.below(spark.createDataFrame([(1,)], "id bigint")).isEmpty()


def test_delete_with_an_index(shop, spark, tmp_path):
    ids = spark.createDataFrame([(4,), (2,), (99,)], "id bigint")
    bare = shop.with_(nomenclature=shop.nomenclature.limit(0))
    index = SubtreeIndex.build(bare.categories, str(tmp_path / "index"))
    walked, joined = delete_subtree(bare, ids), delete_subtree(bare, ids, index)
    assert sorted(tuples(joined.table, "id")) == sorted(tuples(walked.table, "id"))
    assert sorted(tuples(joined.rejected, "id", "reason")) == [(99, "unknown_id")]
