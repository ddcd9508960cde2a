"""Structural join: the pairs of a node and its ancestors on an allowed way, in one pass over sorted nodes.

Nodes are dealt out by document and sorted by position, so that a node comes
before all that it has below it. Each task goes once through its nodes, batch by batch, and
carries only the nodes that are still open (the way from the root to the last
node) into the next batch: memory is a batch and the depth of a tree, not a tree. Every node has a hop,
its nearest ancestor that may be given; the pairs of a batch are the hops from its nodes, the hops from
there, and so on. The work is linear in nodes and pairs.

A way goes up from a node step by step. Three conditions on nodes say which ways are allowed:
``leave`` for every node that a step goes from, ``enter`` for every node that it
goes to, ``through`` for the nodes between the two ends.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trees import TREE


def hops(parent: np.ndarray, level: np.ndarray, leave: np.ndarray, enter: np.ndarray, through: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Index of each node's nearest ancestor on an allowed way that is upper, -1 if there is none.

    parent: index of the parent, before the node; -1 for a root.
    """
    hop = np.full(len(parent), -1)
    order = np.argsort(level, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        part = part[(parent[part] >= 0) & leave[part]]
        p = parent[part]
        ok = enter[p]
        part, p = part[ok], p[ok]
        hop[part] = np.where(upper[p], p, np.where(through[p], hop[p], -1))
    return hop


def in_order(rows: DataFrame, placed: bool) -> DataFrame:
    """rows by document and st; placed: they lie so already (see ``trees.shred_in_place``)."""
    # the window deals and sorts the nodes, without a shuffle where they lie by document already
    return rows if placed else rows.withColumn("__at", F.row_number().over(Window.partitionBy("doc_id").orderBy("st")))


def structural_join(nodes: DataFrame, leave: Column | None = None, enter: Column | None = None, through: Column | None = None, lower: Column | None = None, upper: Column | None = None, chosen: Column | None = None, placed: bool = False) -> DataFrame:
    """doc_id, tree_id, a and b: every node b that is lower and its ancestors a that are upper, on an allowed way.

    nodes: the columns of a node table, doc_id, tree_id, st, parent and lvl among them; a missing condition holds.
    chosen: st of the one child from which a step may go to a node. placed: the nodes lie by document, sorted by st.
    """
    flag = lambda c: F.lit(True) if c is None else F.coalesce(c, F.lit(False))
    flags = {"__leave": leave, "__enter": enter, "__through": through, "__upper": upper, "__lower": lower}
    picked = chosen is not None
    one = () if chosen is None else (F.coalesce(chosen, F.lit(-1)).alias("__chosen"),)
    rows = in_order(nodes.select(*TREE, "st", "parent", "lvl", *(flag(c).alias(n) for n, c in flags.items()), *one), placed)
    kind = nodes.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        stack = None
        for batch in batches:
            if not len(batch):
                continue
            n_old = 0
            if stack is not None and batch.column("parent")[0].is_valid:
                n_old = len(stack)
                batch = pa.Table.from_batches([stack, batch]).combine_chunks().to_batches()[0]
            of = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            st, level = of("st").astype(np.int64), of("lvl")
            rooted = batch.column("parent").is_valid().to_numpy(zero_copy_only=False)
            up = batch.column("parent").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            # a tree begins with its root, whose parent is null; inside a tree positions rise
            tree = np.cumsum(~rooted)
            span = int(st.max()) + 2
            parent = np.where(rooted, np.searchsorted(tree * span + st, tree * span + up), -1)
            leave = of("__leave")
            if picked:
                leave = leave & (parent >= 0) & (of("__chosen")[parent] == st)
            hop = hops(parent, level, leave, *(of(f"__{n}") for n in ("enter", "through", "upper")))
            through = of("__through")
            b = np.flatnonzero(of("__lower"))
            b = b[b >= n_old]
            a = hop[b]
            while True:
                b, a = b[a >= 0], a[a >= 0]
                if not len(a):
                    break
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(b)), batch.column("tree_id").take(pa.array(b)), pa.array(st[a]), pa.array(st[b])], names=["doc_id", "tree_id", "a", "b"])
                a = np.where(through[a], hop[a], -1)
            way, at = [], len(st) - 1
            while at >= 0:
                way.append(at)
                at = int(parent[at])
            stack = batch.take(pa.array(way[::-1]))

    return rows.mapInArrow(run, f"doc_id {kind}, tree_id int, a long, b long").select(*TREE, F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
