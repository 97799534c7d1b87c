"""Connected components by alternating large and small stars.

Each step only groups edges by a node and keeps minima, so no component and no
node's neighbourhood is ever collected; edges are written down between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlytics.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; a component is named by its smallest node.

    `edges` has two columns, `a` and `b`. Loops and repeated edges do no harm.
    """
    stars = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    before = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head()
        if tuple(now) == before:
            break
        before = tuple(now)
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = cut_lineage(large, "large-star")
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi")
        turned = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = cut_lineage(turned.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
    own = stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(own)
