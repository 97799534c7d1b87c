"""The category tree: closure, paths, children, descendants, broken nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlytics.operators.running import POSITION, placed
from orderlytics.session import read_back, scratch_path, write_counted

ARROW = " -> "


def category_closure(categories: DataFrame, active_only: bool = True) -> DataFrame:
    """Every node reachable from a root: depth, full path and path of ids.

    Every node holds a pointer to an ancestor, at first its parent, and the path
    between; a round replaces the pointer by the ancestor's own and doubles the
    distance, so a tree of depth d takes about log2(d) rounds, each one join
    written to the shared folder. Where a round brings no node to a root, those
    left lie on a cycle or under a missing parent. An inactive node hides its
    subtree when `active_only`.
    """
    nodes = categories.where("is_active") if active_only else categories
    kept = ["id", "name", "parent_id", "level"]
    state = nodes.select(
        *kept, F.col("parent_id").alias("up"), F.array("name").alias("names"), F.array("id").alias("path_array")
    )
    base = scratch_path(categories.sparkSession, "closure")
    rounds: list[str] = []
    while True:
        path = f"{base}/{len(rounds)}"
        state.write.parquet(path)
        rounds.append(path)
        now = read_back(state, path)
        if now.where("up IS NULL").isEmpty() or (waiting := now.where("up IS NOT NULL")).isEmpty():
            break
        # Those a former round brought to a root, and all of this one.
        known = read_back(state, *rounds).where("up IS NULL").unionByName(waiting)
        above = known.select(
            F.col("id").alias("up"),
            F.col("up").alias("next_up"),
            F.col("names").alias("above_names"),
            F.col("path_array").alias("above_ids"),
        )
        state = waiting.join(above, "up").select(
            *kept,
            F.col("next_up").alias("up"),
            F.concat("above_names", "names").alias("names"),
            F.concat("above_ids", "path_array").alias("path_array"),
        )
    unnamed = F.exists("names", lambda name: name.isNull())
    return (
        read_back(state, *rounds)
        .where("up IS NULL")
        .select(
            *kept,
            (F.size("path_array") - 1).alias("depth"),
            F.when(~unnamed, F.array_join("names", ARROW)).alias("full_path"),
            "path_array",
        )
    )


def labels(path_array: str = "path_array") -> F.Column:
    """Path of text labels: the tree order compares label by label as text."""
    return F.col(path_array).cast("array<string>")


def dotted(path_array: str = "path_array") -> F.Column:
    return F.array_join(labels(path_array), ".")


def category_path(categories: DataFrame) -> DataFrame:
    """Path and level of every reachable node, computed anew from the parents."""
    return category_closure(categories, active_only=False).select(
        "id", dotted().alias("path"), (F.size("path_array") - 1).alias("level")
    )


def category_hierarchy(categories: DataFrame) -> DataFrame:
    """The hierarchy view: all reachable categories, active or not."""
    return category_closure(categories, active_only=False).select(
        "id", "name", "parent_id", dotted().alias("path"), "level", "depth", "full_path"
    )


def category_tree(categories: DataFrame) -> DataFrame:
    """Active nodes in path order, a row per node and direct child with the child's position, from 0.

    Nodes without a parent are the roots; a node without children is one row
    whose `position` and `child` are NULL.
    """
    tree = category_closure(categories).select("id", "name", "parent_id", "level", labels().alias("_labels"))
    child = tree.where("parent_id IS NOT NULL").select(
        F.col("parent_id").alias("id"),
        F.element_at("_labels", -1).alias("label"),
        F.struct("id", "name", "level").alias("child"),
    )
    return (
        tree.join(placed(child, ["id"], ["label"], "children"), "id", "left")
        .orderBy("_labels", POSITION)
        .select("id", "name", "parent_id", "level", F.array_join("_labels", ".").alias("path"), POSITION, "child")
    )


def category_display(categories: DataFrame) -> DataFrame:
    """Names indented by two spaces per level, in path order, inactive included."""
    return (
        category_closure(categories, active_only=False)
        .orderBy(labels())
        .select(
            "id",
            "name",
            "level",
            dotted().alias("path"),
            F.concat(F.repeat(F.lit("  "), F.col("level")), "name").alias("tree_display"),
        )
    )


def three_level_names(categories: DataFrame) -> DataFrame:
    """Active roots with the names of their children and grandchildren."""
    root = categories.where("parent_id IS NULL AND is_active").select(
        F.col("id").alias("root_id"), F.col("name").alias("root")
    )
    child = categories.select(
        F.col("parent_id").alias("root_id"), F.col("id").alias("child_id"), F.col("name").alias("child")
    )
    grandchild = categories.select(F.col("parent_id").alias("child_id"), F.col("name").alias("grandchild"))
    return (
        root.join(child, "root_id", "left")
        .join(grandchild, "child_id", "left")
        .orderBy("root", "child", "grandchild")
        .select("root", "child", "grandchild")
    )


def below(categories: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs of a given node and each node of its subtree, itself included, with the distance.

    The walk goes down from the given ids only, one level of all subtrees a round.
    A pair already seen is not followed again, so a cycle ends. Ids that are no
    category have no subtree.
    """
    known = ids.select("id").distinct().join(categories.select("id"), "id", "left_semi")
    level = known.select(
        F.col("id").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(0).alias("distance")
    )
    children = categories.where("parent_id IS NOT NULL").select(
        F.col("parent_id").alias("descendant_id"), F.col("id").alias("child_id")
    )
    base = scratch_path(categories.sparkSession, "below")
    levels: list[str] = []
    while True:
        path = f"{base}/{len(levels)}"
        found = write_counted(level, path)
        levels.append(path)
        if found == 0:
            return read_back(level, *levels)
        under = read_back(level, path).join(children, "descendant_id")
        under = under.select("ancestor_id", F.col("child_id").alias("descendant_id"), (F.col("distance") + 1).alias("distance"))
        pair = ["ancestor_id", "descendant_id"]
        level = under.dropDuplicates(pair).join(read_back(level, *levels).select(*pair), pair, "left_anti")


def descendants(categories: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Pairs of a node and everything below it, with the distance; the node itself is left out.

    Without `ids`, of all nodes that a root leads to. With `ids`, of these nodes
    wherever they are, on a cycle too.
    """
    if ids is not None:
        return below(categories, ids).where("distance > 0")
    nodes = category_closure(categories, active_only=False).select(
        F.col("id").alias("descendant_id"),
        F.size("path_array").alias("_length"),
        F.posexplode("path_array").alias("_at", "ancestor_id"),
    )
    pairs = nodes.select("ancestor_id", "descendant_id", (F.col("_length") - 1 - F.col("_at")).alias("distance"))
    return pairs.where("distance > 0")


def unreachable_nodes(categories: DataFrame) -> DataFrame:
    """Nodes on a cycle or under a missing parent, which every tree query skips."""
    reachable = category_closure(categories, active_only=False).select("id")
    return categories.join(reachable, "id", "left_anti")
