"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in links (a, b).

    Every node has a parent, at first itself. In each round the smallest
    grandparent among a node's neighbours becomes the parent of the node and of its
    parent, if it is smaller, and every node moves up to its grandparent. Since
    whole trees are hooked, not only nodes, long chains take about as many rounds as the
    logarithm of their length. A node with many links is only ever a key of a
    join or of a partial aggregate.
    """
    both = scratch.save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parents = scratch.save(both.select(F.col("a").alias("node")).distinct().withColumn("parent", F.col("node")))
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        known = scratch.save(parents.join(above, "parent"))
        least = both.join(known.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("least"))
        moves = known.join(least, known.node == least.a).select("node", "parent", "grand", "least")
        to = F.inline(F.array(F.struct(F.col("node").alias("child"), F.least("grand", "least").alias("to")), F.struct(F.col("parent").alias("child"), F.col("least").alias("to"))))
        moves = moves.select(to).groupBy("child").agg(F.min("to").alias("to"))
        after = known.join(moves, known.node == moves.child).select("node", F.least("parent", "to").alias("parent"), (F.col("to") < F.col("parent")).alias("moved"))
        after = scratch.save(after)
        moved = not after.where("moved").isEmpty()
        scratch.drop(parents, known)
        parents = after.select("node", "parent")
        parents._scratch_path = after._scratch_path
        if not moved:
            scratch.drop(both)
            return parents.select("node", F.col("parent").alias("component"))
