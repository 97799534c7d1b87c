from __future__ import annotations

from collections import Counter

from helpers import tuples

from pyspark.sql import functions as F

from orderlytics.operators import hierarchy
from orderlytics.operators.changes import delete_subtree


def test_closure(shop):
    rows = tuples(hierarchy.category_closure(shop.categories), "id", "depth", "full_path", "path_array")
    assert Counter(r[1] for r in rows) == {0: 2, 1: 5, 2: 4}
    assert {r[0]: r[2:] for r in rows}[8] == ("Бытовая техника -> Холодильники -> однокамерные", [1, 4, 8])


def test_paths_and_display(shop):
    assert dict((r[0], r[1:]) for r in tuples(hierarchy.category_path(shop.categories)))[11] == ("2.6.11", 2)
    shown = tuples(hierarchy.category_display(shop.categories), "path", "tree_display")
    # Labels compare as text: 10 comes before 9 would, and 1.4 before 1.5.
    assert [p for p, _ in shown] == ["1", "1.3", "1.4", "1.4.8", "1.4.9", "1.5", "2", "2.6", "2.6.10", "2.6.11", "2.7"]
    assert shown[3][1] == "    однокамерные"


def test_inactive_node_cuts_its_subtree(make):
    nodes = make("categories", "id, name, parent_id, is_active", [(1, "a", None, True), (2, "b", 1, False), (3, "c", 2, True), (4, "d", None, False)])
    assert tuples(hierarchy.category_closure(nodes), "id") == [(1,)]
    assert sorted(tuples(hierarchy.category_closure(nodes, active_only=False), "id")) == [(1,), (2,), (3,), (4,)]


def test_cycles_and_orphans_are_unreachable(make):
    nodes = make("categories", "id, name, parent_id", [(1, "a", None), (2, "b", 3), (3, "c", 2), (4, "d", 3), (5, "e", 99), (6, "f", 1)])
    assert sorted(tuples(hierarchy.unreachable_nodes(nodes), "id")) == [(2,), (3,), (4,), (5,)]


def test_deep_chain(make):
    nodes = make("categories", "id, name, parent_id", [(1, "n1", None), *[(n, f"n{n}", n - 1) for n in range(2, 13)]])
    rows = tuples(hierarchy.category_path(nodes).where("level = 11"))
    assert rows == [(12, ".".join(str(n) for n in range(1, 13)), 11)]


def test_tree_children_in_path_order(shop):
    rows = hierarchy.category_tree(shop.categories).collect()
    assert list(dict.fromkeys(r.id for r in rows)) == [1, 3, 4, 8, 9, 5, 2, 6, 10, 11, 7]
    seen = [(r.id, r.position, r.child and r.child.id) for r in rows if r.id in (1, 2, 4, 8)]
    assert seen == [(1, 0, 3), (1, 1, 4), (1, 2, 5), (4, 0, 8), (4, 1, 9), (8, None, None), (2, 0, 6), (2, 1, 7)]


def test_tree_has_one_grain_for_families_of_any_size(make):
    children = [(n, f"k{n}", 1) for n in range(2, 10_003)]
    nodes = make("categories", "id, name, parent_id", [(1, "root", None), *children])
    rows = [r for r in hierarchy.category_tree(nodes).collect() if r.id == 1]
    assert [(r.position, r.child.id) for r in rows] == list(enumerate(sorted(range(2, 10_003), key=str)))


def test_descendants(shop, spark):
    pairs = set(tuples(hierarchy.descendants(shop.categories), "ancestor_id", "descendant_id", "distance"))
    assert {(1, 8, 2), (1, 4, 1), (4, 8, 1), (2, 11, 2)} <= pairs
    assert len(pairs) == 5 + 4 * 2
    some = hierarchy.descendants(shop.categories, spark.createDataFrame([(6,)], "id bigint"))
    assert sorted(tuples(some, "descendant_id")) == [(10,), (11,)]


def test_delete_subtree(shop, spark):
    ids = spark.createDataFrame([(4,), (2,), (99,)], "id bigint")
    bare = shop.with_(nomenclature=shop.nomenclature.limit(0))
    done = delete_subtree(bare, ids)
    assert sorted(tuples(done.table, "id")) == [(1,), (3,), (5,)]
    assert tuples(done.rejected, "id", "reason") == [(99, "unknown_id")]
    stocked = shop.with_(nomenclature=shop.nomenclature.limit(1).withColumn("category_id", F.lit(8).cast("bigint")))
    done = delete_subtree(stocked, ids)
    assert sorted(tuples(done.table, "id")) == [(1,), (3,), (4,), (5,), (8,), (9,)]
    assert sorted(tuples(done.rejected, "id", "reason")) == [(4, "has_products"), (99, "unknown_id")]


def test_subtree_on_a_cycle(shop, make):
    nodes = make("categories", "id, name, parent_id", [(1, "a", None), (10, "b", 11), (11, "c", 10), (12, "d", 11)])
    wanted = nodes.where("id = 10")
    pairs = sorted(tuples(hierarchy.descendants(nodes, wanted), "descendant_id", "distance"))
    assert pairs == [(11, 1), (12, 2)]
    done = delete_subtree(shop.with_(categories=nodes, nomenclature=shop.nomenclature.limit(0)), wanted)
    assert tuples(done.table, "id") == [(1,)]
    assert done.rejected.isEmpty()


def test_three_levels(shop):
    rows = tuples(hierarchy.three_level_names(shop.categories))
    assert len(rows) == 7
    assert ("Бытовая техника", "Телевизоры", None) in rows
    assert ("Компьютеры", "Ноутбуки", '17"') in rows


def test_hierarchy_view_keeps_inactive(make):
    nodes = make("categories", "id, name, parent_id, is_active", [(1, "a", None, False), (2, "b", 1, True)])
    assert sorted(tuples(hierarchy.category_hierarchy(nodes), "id", "depth")) == [(1, 0), (2, 1)]


def test_a_deep_chain_takes_few_rounds_and_broken_nodes_stay_out(spark, monkeypatch):
    """A chain of 5,000 nodes, a cycle with a tail, and a subtree under a missing parent."""
    rows = [(n, f"n{n}", n - 1 if n else None) for n in range(5000)]
    rows += [(10_000 + n, "c", 10_000 + (n + 1) % 7) for n in range(7)] + [(10_100 + n, "t", 10_099 + n if n else 10_003) for n in range(20)]
    rows += [(20_000, "m", 30_000), (20_001, "m", 20_000), (5000, "side", 2500)]
    categories = spark.createDataFrame(rows, "id bigint, name string, parent_id bigint").selectExpr("*", "0 AS level", "true AS is_active")
    written = []
    keep = hierarchy.scratch_path
    monkeypatch.setattr(hierarchy, "scratch_path", lambda *a: written.append(keep(*a)) or written[-1])
    found = hierarchy.category_closure(categories)
    assert sorted(tuples(found, "id", "depth")) == [*((n, n) for n in range(5000)), (5000, 2501)]
    deep = found.where("id = 4999").first()
    assert deep.path_array == list(range(5000)) and deep.full_path == " -> ".join(f"n{n}" for n in range(5000))
    folder = spark._jvm.org.apache.hadoop.fs.Path(written[0])
    rounds = len(folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))
    assert rounds <= 15
    assert sorted(tuples(hierarchy.unreachable_nodes(categories), "id")) == sorted((r[0],) for r in rows if r[0] >= 10_000)


def test_trees_without_roots_or_nodes(spark):
    schema = "id bigint, name string, parent_id bigint, level int, is_active boolean"
    assert hierarchy.category_closure(spark.createDataFrame([], schema)).count() == 0
    loop = [(1, "a", 2, 0, True), (2, "b", 1, 0, True)]
    assert hierarchy.category_closure(spark.createDataFrame(loop, schema)).count() == 0
    shallow = [(1, "a", None, 0, True), (2, None, 1, 0, True), (3, "c", 2, 0, True), (4, "d", 1, 0, False)]
    found = hierarchy.category_closure(spark.createDataFrame(shallow, schema))
    assert sorted(tuples(found, "id", "depth", "full_path")) == [(1, 0, "a"), (2, 1, None), (3, 2, None)]
