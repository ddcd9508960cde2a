"""Properties of tree nodes: kinds of nodes, text, head words, paths and children by index (folds.py has equality and lowest common ancestors).

Input is the node table of ``trees.shred``; with heads where a head is asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .structural import structural_join
from .trees import TREE, Nodes, child, from_children, inside


def kinds(nodes: DataFrame) -> DataFrame:
    """Adds phrasal, unary, prepreterminal and binary.

    phrasal: neither a leaf nor above one leaf only; unary: one child; prepreterminal: all children
    stand above one leaf only; binary: every node from here down is a leaf, above one leaf
    only, or has two children.
    """
    n = from_children(nodes, n_kids=F.count(child(F.lit(1))), all_pre=F.bool_and(child(F.col("pre"))))
    n = n.withColumns({"phrasal": ~F.col("is_leaf") & ~F.col("pre"), "unary": F.col("n_kids") == 1, "prepreterminal": F.coalesce("all_pre", F.lit(False)), "odd": ~F.col("is_leaf") & ~F.col("pre") & (F.col("n_kids") != 2)})
    n = inside(n, "odd")
    return n.withColumn("binary", ~F.col("odd") & (F.col("below_odd") == 0)).drop("odd", "below_odd", "above_odd", "all_pre")


def _odd(nodes: Nodes) -> np.ndarray:
    return ~nodes.is_leaf & ~nodes.pre & (nodes.n_kids != 2)


#: What ``kinds`` adds, as columns for ``trees.shred_in_place``.
KINDS = {
    "phrasal": ("boolean", lambda nodes, rows: pa.array((~nodes.is_leaf & ~nodes.pre)[rows])),
    "unary": ("boolean", lambda nodes, rows: pa.array((nodes.n_kids == 1)[rows])),
    "prepreterminal": ("boolean", lambda nodes, rows: pa.array(((nodes.n_kids > 0) & ~nodes.some_kid(~nodes.pre))[rows])),
    "binary": ("boolean", lambda nodes, rows: pa.array(~(_odd(nodes) | nodes.over(_odd(nodes)))[rows])),
}


def leaves_below(nodes: Nodes) -> np.ndarray:
    """How many leaves each node has below it, or is."""
    met = np.append(0, np.cumsum(nodes.is_leaf))
    return met[nodes.last + 1] - met[:-1]


def span(nodes: Nodes, rows: np.ndarray) -> pa.Array:
    """The leaves below each of the rows (or itself) joined by blanks."""
    leaves = np.flatnonzero(nodes.is_leaf & nodes.label.is_valid().to_numpy(zero_copy_only=False))
    low = np.searchsorted(leaves, rows)
    n = np.searchsorted(leaves, nodes.last[rows], "right") - low
    bounds = np.append(0, np.cumsum(n))
    own = leaves[np.repeat(low - bounds[:-1], n) + np.arange(bounds[-1])]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), nodes.label.take(pa.array(own))), " ")


def texts(nodes: DataFrame) -> DataFrame:
    """doc_id, tree_id, st and text: the bracket text of every node; equal texts are equal trees."""
    opened = F.when(F.col("is_leaf"), F.col("label")).otherwise(F.concat(F.lit("("), F.coalesce("label", F.lit(""))))
    events = nodes.select(*TREE, "st", "en", F.inline(F.array(F.struct(F.lit(False).alias("end"), opened.alias("txt")), F.struct(F.lit(True).alias("end"), F.when(~F.col("is_leaf"), F.lit(")")).alias("txt")))))
    events = events.withColumn("at", F.when(F.col("end"), F.col("en")).otherwise(F.col("st"))).where("txt IS NOT NULL")
    events = events.withColumn("i", F.row_number().over(Window.partitionBy(*TREE).orderBy("at", "end")))
    own = events.groupBy(*TREE, "st").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    parts = events.groupBy(*TREE).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "txt"))), lambda x: x["txt"]).alias("parts"))
    text = F.array_join(F.slice("parts", F.col("first"), F.col("last") - F.col("first") + 1), " ")
    return own.join(parts, TREE).select(*TREE, "st", F.regexp_replace(text, r" \)", ")").alias("text"))


def head_words(axis_nodes: DataFrame) -> DataFrame:
    """doc_id, tree_id, st and word: the leaf at the end of a node's chain of heads, itself for a leaf.

    Seen from below, a leaf heads the nodes that a way of heads leads up to.
    """
    leaf = axis_nodes.where("is_leaf").select(*TREE, F.col("st").alias("b"), F.col("label").alias("word"))
    below = structural_join(axis_nodes, leave=F.col("is_head"), lower=F.col("is_leaf")).join(leaf, [*TREE, "b"]).select(*TREE, F.col("a").alias("st"), "word")
    return below.unionByName(leaf.select(*TREE, F.col("b").alias("st"), "word"))


def paths(nodes: DataFrame) -> DataFrame:
    """doc_id, tree_id, st, step (from 0, the node itself) and node: the way up, without the root."""
    own = nodes.where("parent IS NOT NULL").select(*TREE, "st", F.lit(0).alias("step"), F.col("st").alias("node"))
    at = lambda x: nodes.select(*TREE, F.col("st").alias(x), F.col("lvl").alias(f"lvl_{x}"))
    up = structural_join(nodes, upper=F.col("parent").isNotNull()).join(at("a"), [*TREE, "a"]).join(at("b"), [*TREE, "b"])
    return own.unionByName(up.select(*TREE, F.col("b").alias("st"), (F.col("lvl_b") - F.col("lvl_a")).cast("int").alias("step"), F.col("a").alias("node")))


def chosen(at: int | slice, ci, n):
    """Whether child ci of n is at an index, or in a slice, as lists have them."""
    if isinstance(at, int):
        return ci == (F.lit(at) if at >= 0 else n + at)
    step = 1 if at.step is None else at.step
    if step == 0:
        raise ValueError("the step of a slice is not 0")
    low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)
    bound = lambda x: F.greatest(n + x, low) if x < 0 else F.least(F.lit(x), high)
    first = (low if step > 0 else high) if at.start is None else bound(at.start)
    stop = (high if step > 0 else low) if at.stop is None else bound(at.stop)
    if step > 0:
        return (ci >= first) & (ci < stop) & ((ci - first) % step == 0)
    return (ci <= first) & (ci > stop) & ((first - ci) % -step == 0)


def item(nodes: DataFrame, path: list[int | slice]) -> DataFrame:
    """doc_id, tree_id, st and node: the descendants that a path of child indexes and slices leads to; a negative index counts from the last child."""
    found = nodes.select(*TREE, "st", F.col("st").alias("node"))
    for at in path:
        # a child knows its index and how many sisters there are, itself included
        kids = nodes.where(F.col("parent").isNotNull() & chosen(at, F.col("ci"), F.col("sisters")))
        found = found.join(kids.select(*TREE, F.col("parent").alias("node"), F.col("st").alias("kid")), [*TREE, "node"]).select(*TREE, "st", F.col("kid").alias("node"))
    return found
