"""Subtree index: intervals that turn "everything below" into a range join.

A tree is a walk around it: every node is entered once and left once. The steps
of the walk are a linked list, and their places in it come from list ranking:
every step holds a pointer and what lies between, and a round replaces the pointer
by that of the step it points to. So n nodes take about log2(2n) rounds, each one
join, however deep the trees are, and no row holds a path.

A node then has the numbers `top` and `under`: a node of the same tree lies in its
subtree where its own `top` is in (under, top]. A node under a missing parent is the
head of a tree of its own. Nodes on a cycle are too, and are marked: what lies below
one of them is the whole cycle with its trees, which a walk finds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.operators.hierarchy import below
from orderlytics.operators.running import POSITION, placed
from orderlytics.session import cut_lineage, read_back, scratch_path

#: Numbers of a tree that one bucket of the range join holds.
BLOCK = 128
STEP = ["id", "leaving"]
PAIR = ["ancestor_id", "descendant_id"]


def cycle_nodes(categories: DataFrame) -> DataFrame:
    """Ids of nodes that are their own ancestors.

    Pointers to an ancestor double their distance each round; what reaches a root or
    a missing parent drops out. The nodes still pointed at become fewer until only
    those on cycles are left, which point at each other for ever.
    """
    ids = categories.select(F.col("id").alias("up"))
    state = categories.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("up"))
    state = state.join(ids, "up", "left_semi")
    base = scratch_path(categories.sparkSession, "cycles")
    targets, n = None, 0
    while True:
        path = f"{base}/{n}"
        state.select("id", "up").write.parquet(path)
        now = read_back(state.select("id", "up"), path)
        left = now.select("up").distinct().count()
        if left in (0, targets):
            return now.select(F.col("up").alias("id")).distinct()
        targets, n = left, n + 1
        state = now.join(now.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select(
            "id", F.col("next").alias("up")
        )


def _steps(nodes: DataFrame) -> DataFrame:
    """The walks around all trees: a row per step with the step after it, NULL after the last.

    `entries` counts the nodes entered from here up to the pointer, `rise` the
    levels gone down less those gone up; `root_id` is known at the last step.
    """
    heads = nodes.where("up IS NULL").select("id")
    children = placed(nodes.where("up IS NOT NULL").select("up", "id"), ["up"], ["id"], "siblings")
    children = cut_lineage(children, "siblings")
    first = children.where(f"{POSITION} = 0").select(F.col("up").alias("id"), F.col("id").alias("child"))
    into = nodes.join(first, "id", "left").select(
        "id",
        F.lit(False).alias("leaving"),
        F.coalesce("child", "id").alias("to_id"),
        F.col("child").isNull().alias("to_leaving"),
    )
    nexts = children.select("up", (F.col(POSITION) - 1).alias(POSITION), F.col("id").alias("sibling"))
    out = children.join(nexts, ["up", POSITION], "left").select(
        "id",
        F.lit(True).alias("leaving"),
        F.coalesce("sibling", "up").alias("to_id"),
        F.col("sibling").isNull().alias("to_leaving"),
    )
    none = F.lit(None)
    last = heads.select("id", F.lit(True).alias("leaving"), none.cast("bigint").alias("to_id"), none.cast("boolean").alias("to_leaving"))
    weight = F.when(F.col("leaving"), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    return (
        into.unionByName(out)
        .unionByName(last)
        .withColumns({"entries": weight, "rise": 2 * weight - 1})
        .withColumn("root_id", F.when(F.col("to_id").isNull(), F.col("id")))
    )


def _ranked(steps: DataFrame) -> DataFrame:
    """Every step with what lies between it and the end of its walk."""
    base = scratch_path(steps.sparkSession, "ranks")
    rounds: list[str] = []
    state = steps
    while True:
        path = f"{base}/{len(rounds)}"
        state.write.parquet(path)
        rounds.append(path)
        waiting = read_back(state, path).where("to_id IS NOT NULL")
        if waiting.isEmpty():
            return read_back(state, *rounds).where("to_id IS NULL").select(*STEP, "entries", "rise", "root_id")
        known = read_back(state, *rounds).where("to_id IS NULL").unionByName(waiting)
        ahead = known.select(
            F.col("id").alias("to_id"),
            F.col("leaving").alias("to_leaving"),
            F.col("to_id").alias("next_id"),
            F.col("to_leaving").alias("next_leaving"),
            F.col("entries").alias("more_entries"),
            F.col("rise").alias("more_rise"),
            F.col("root_id").alias("end_id"),
        )
        state = waiting.join(ahead, ["to_id", "to_leaving"]).select(
            *STEP,
            F.col("next_id").alias("to_id"),
            F.col("next_leaving").alias("to_leaving"),
            (F.col("entries") + F.col("more_entries")).alias("entries"),
            (F.col("rise") + F.col("more_rise")).alias("rise"),
            F.col("end_id").alias("root_id"),
        )


@dataclass(frozen=True)
class SubtreeIndex:
    """A folder with `nodes`: id, parent_id, root_id, top, under, depth, on_cycle; kept per table version."""

    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, categories: DataFrame, folder: str) -> SubtreeIndex:
        spark = categories.sparkSession
        on_cycle = cut_lineage(cycle_nodes(categories), "on-cycle")
        ids = categories.select(F.col("id").alias("parent_id"), F.lit(True).alias("_has_parent"))
        nodes = (
            categories.select("id", "parent_id")
            .join(on_cycle.withColumn("_cycle", F.lit(True)), "id", "left")
            .join(ids, "parent_id", "left")
            .select("id", "parent_id", F.coalesce("_cycle", F.lit(False)).alias("on_cycle"), "_has_parent")
        )
        attached = F.col("_has_parent").isNotNull() & ~F.col("on_cycle")
        nodes = nodes.withColumn("up", F.when(attached, F.col("parent_id")))
        nodes = cut_lineage(nodes.select("id", "parent_id", "on_cycle", "up"), "tree-nodes")
        ranks = _ranked(_steps(nodes.select(F.col("id").cast("bigint").alias("id"), F.col("up").cast("bigint").alias("up"))))
        numbers = ranks.groupBy("id").agg(
            F.first("root_id").alias("root_id"),
            F.max(F.when(~F.col("leaving"), F.col("entries"))).alias("top"),
            F.max(F.when(F.col("leaving"), F.col("entries"))).alias("under"),
            F.max(F.when(~F.col("leaving"), -F.col("rise"))).alias("depth"),
        )
        placed_nodes = nodes.drop("up").join(numbers, "id")
        placed_nodes.write.parquet(f"{folder}/nodes")
        return cls(spark, folder)

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/nodes")

    def below(self, ids: DataFrame) -> DataFrame:
        """As `hierarchy.below`: pairs of a given node and each node of its subtree, itself included.

        A subtree of k nodes meets at most 2 * BLOCK nodes beside its own. Given nodes
        on a cycle are walked level by level, once for all of them; without such ids no walk starts.
        """
        nodes = self.nodes()
        given = cut_lineage(ids.select("id").distinct().join(nodes, "id"), "given-nodes")
        block = lambda number: F.floor(F.col(number) / BLOCK).cast("bigint")
        spans = given.where("NOT on_cycle").select(
            F.col("id").alias("ancestor_id"),
            "root_id",
            F.col("top").alias("_top"),
            F.col("under").alias("_under"),
            F.col("depth").alias("_depth"),
            F.explode(F.sequence(F.floor((F.col("under") + 1) / BLOCK).cast("bigint"), block("top"))).alias("_block"),
        )
        held = nodes.select(F.col("id").alias("descendant_id"), "root_id", "top", "depth", block("top").alias("_block"))
        inside = (F.col("top") > F.col("_under")) & (F.col("top") <= F.col("_top"))
        found = spans.join(held, ["root_id", "_block"]).where(inside)
        found = found.select(*PAIR, (F.col("depth") - F.col("_depth")).cast("int").alias("distance"))
        looped = given.where("on_cycle").select("id")
        if looped.isEmpty():
            return found
        return found.unionByName(below(nodes.select("id", "parent_id"), looped))

    def sizes(self) -> DataFrame:
        """(id, n_below): how many nodes lie below each node that is on no cycle; no join at all."""
        return self.nodes().where("NOT on_cycle").select("id", (F.col("top") - F.col("under") - 1).alias("n_below"))

