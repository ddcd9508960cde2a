"""Tree axes as join conditions between two node rows a and b of one tree.

Conditions are SQL text over the columns of ``axis_nodes``. Axes up and down a tree are ways for the structural join, which is
linear in nodes and pairs. A node's row says who its parent is, so axes between parent and child are rows that fit; sisters and
nodes that touch are gathered by family or edge. Nothing of these joins the node table with itself: nodes that lie
by document stay where they are. Chains of neighbours are closed over the positions of a tree, from right to left.
Only precedes, follows and same_tree give about all pairs of a tree, which is their result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .heads import HEAD_ST
from .structural import in_order, structural_join
from .trees import TREE, shred_in_place

#: Pairs of a batch that a task gives out at once, about.
PAIRS = 1 << 18
#: Leaves of a tree, up to which the positions that chains reach are listed for many trees at once; those of larger trees are bits.
POSITIONS = 512
DOMINATES = "a.st < b.st AND a.en > b.en"
SAME = "a.st = b.st"

#: name -> (Tregex symbol, condition of "a rel b")
SIMPLE = {
    "dominates": ("<<", DOMINATES),
    "dominated_by": (">>", "b.st < a.st AND b.en > a.en"),
    "only_child_of": (">:", "a.parent = b.st AND b.n_kids = 1"),
    "has_only_child": ("<:", "b.parent = a.st AND a.n_kids = 1"),
    "last_child_of": (">-", "a.parent = b.st AND a.ci = b.n_kids - 1"),
    "parent_of_last_child": ("<-", "b.parent = a.st AND b.ci = a.n_kids - 1"),
    "leftmost_child_of": (">,", "a.parent = b.st AND a.ci = 0"),
    "has_leftmost_child": ("<,", "b.parent = a.st AND b.ci = 0"),
    "has_rightmost_descendant": ("<<-", f"{DOMINATES} AND a.right_edge = b.right_edge"),
    "rightmost_descendant_of": (">>-", "b.st < a.st AND b.en > a.en AND a.right_edge = b.right_edge"),
    "has_leftmost_descendant": ("<<,", f"{DOMINATES} AND a.left_edge = b.left_edge"),
    "leftmost_descendant_of": (">>,", "b.st < a.st AND b.en > a.en AND a.left_edge = b.left_edge"),
    "left_sister_of": ("$++", "a.parent = b.parent AND a.ci < b.ci"),
    "right_sister_of": ("$--", "a.parent = b.parent AND a.ci > b.ci"),
    "immediate_left_sister_of": ("$+", "a.parent = b.parent AND b.ci = a.ci + 1"),
    "immediate_right_sister_of": ("$-", "a.parent = b.parent AND b.ci = a.ci - 1"),
    "parent_of": ("<", "b.parent = a.st"),
    "child_of": (">", "a.parent = b.st"),
    "sister_of": ("$", "a.parent = b.parent AND a.st <> b.st"),
    "equals": ("==", SAME),
    "parent_equals": ("<=", f"({SAME} OR b.parent = a.st)"),
    "immediately_heads": (">#", "a.st = b.head_st"),
    "immediately_headed_by": ("<#", "b.st = a.head_st"),
    "precedes": ("..", "a.right_edge <= b.left_edge"),
    "immediately_precedes": (".", "a.right_edge = b.left_edge"),
    "follows": (",,", "b.right_edge <= a.left_edge"),
    "immediately_follows": (",", "b.right_edge = a.left_edge"),
    "ancestor_of_leaf": ("<<<", f"{DOMINATES} AND b.is_leaf"),
    "same_tree": (":", "TRUE"),
}

#: name -> (symbol, condition of "a rel b", condition on a node x that breaks the path); they say what WAYS must give
PATHS = {
    "unary_path_ancestor_of": ("<<:", DOMINATES, "x.n_kids > 1 AND x.st >= a.st AND x.en <= a.en AND x.st < b.st AND x.en > b.en"),
    "unary_path_descendant_of": (">>:", "b.st < a.st AND b.en > a.en", "x.n_kids > 1 AND x.st >= b.st AND x.en <= b.en AND x.st < a.st AND x.en > a.en"),
    "heads": (">>#", "b.st < a.st AND b.en > a.en", "NOT x.is_head AND x.st > b.st AND x.en < b.en AND x.st <= a.st AND x.en >= a.en"),
    "headed_by": ("<<#", DOMINATES, "NOT x.is_head AND x.st > a.st AND x.en < a.en AND x.st <= b.st AND x.en >= b.en"),
    "unbroken_dominates": ("<+(C)", DOMINATES, "NOT ({c}) AND x.st > a.st AND x.en < a.en AND x.st < b.st AND x.en > b.en"),
    "unbroken_dominated_by": (">+(C)", "b.st < a.st AND b.en > a.en", "NOT ({c}) AND x.st > b.st AND x.en < b.en AND x.st < a.st AND x.en > a.en"),
}


_LAST, _FIRST = "ci = sisters - 1", "ci = 0"
#: name -> (a is the ancestor, conditions on nodes of the structural join); {c} is the category
WAYS = {
    "dominates": (True, {}),
    "dominated_by": (False, {}),
    "has_rightmost_descendant": (True, {"leave": _LAST}),
    "rightmost_descendant_of": (False, {"leave": _LAST}),
    "has_leftmost_descendant": (True, {"leave": _FIRST}),
    "leftmost_descendant_of": (False, {"leave": _FIRST}),
    "ancestor_of_leaf": (True, {"lower": "is_leaf"}),
    "unary_path_ancestor_of": (True, {"leave": "sisters = 1"}),
    "unary_path_descendant_of": (False, {"leave": "sisters = 1"}),
    "headed_by": (True, {"leave": "is_head"}),
    "heads": (False, {"leave": "is_head"}),
    "unbroken_dominates": (True, {"through": "{c}"}),
    "unbroken_dominated_by": (False, {"through": "{c}"}),
}

#: name -> (a is the child, condition on the child)
FAMILY = {
    "child_of": (True, "true"),
    "parent_of": (False, "true"),
    "only_child_of": (True, "sisters = 1"),
    "has_only_child": (False, "sisters = 1"),
    "last_child_of": (True, _LAST),
    "parent_of_last_child": (False, _LAST),
    "leftmost_child_of": (True, _FIRST),
    "has_leftmost_child": (False, _FIRST),
    "immediately_heads": (True, "is_head"),
    "immediately_headed_by": (False, "is_head"),
}
#: Axes that ask which nodes are heads; the others need the columns of ``shred`` only.
OF_HEADS = ("immediately_heads", "immediately_headed_by", "heads", "headed_by")


def nodes_of(forests: DataFrame, name: str, partitioned: bool = False) -> DataFrame:
    """Nodes of the forests for ``axis`` with placed, with what the axis reads: labels only where heads or categories are asked for."""
    if name in OF_HEADS:
        return shred_in_place(forests, "tree_id", "st", "lvl", "parent", derived={"head_st": HEAD_ST}, partitioned=partitioned)
    return shred_in_place(forests, "tree_id", "st", "lvl", "parent", "ci", "sisters", "is_leaf", "left_edge", "right_edge", "next_st", *(("label",) if name.startswith("unbroken") else ()), partitioned=partitioned)


def numbered(name: str, n: int) -> str:
    """Condition of the axes that count children or leaves, from 1 or from -1 at the other end."""
    if n == 0:
        raise ValueError("children and leaves are counted from 1 or from -1")
    if name == "ith_child_of":
        return f"a.parent = b.st AND a.ci = {n - 1 if n > 0 else f'b.n_kids - {-n}'}"
    if name == "has_ith_child":
        return f"b.parent = a.st AND b.ci = {n - 1 if n > 0 else f'a.n_kids - {-n}'}"
    if name == "ancestor_of_ith_leaf":
        place = f"a.left_edge + {n - 1}" if n > 0 else f"a.right_edge - {-n}"
        return f"{DOMINATES} AND b.is_leaf AND b.left_edge = {place} AND b.left_edge >= a.left_edge AND b.right_edge <= a.right_edge"
    raise ValueError(f"no such axis: {name}")


def axis_nodes(features: DataFrame) -> DataFrame:
    """The columns that conditions use; is_head: the node is its parent's head child, and roots count as such."""
    n = features.select(*TREE, "st", "en", "label", "lvl", "parent", "ci", "sisters", "n_kids", "left_edge", "right_edge", "is_leaf", "head_st")
    # a mother stands a second time, among her children
    twice = F.when(F.col("head_st").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    n = n.withColumn("__up", F.explode(twice))
    family = Window.partitionBy(*TREE, F.when(F.col("__up"), F.col("st")).otherwise(F.col("parent")))
    n = n.withColumn("__head", F.max(F.when(F.col("__up"), F.col("head_st"))).over(family)).where("NOT __up")
    return n.withColumn("is_head", F.col("parent").isNull() | F.coalesce(F.col("__head") == F.col("st"), F.lit(False))).drop("__up", "__head")


def pairs(nodes: DataFrame, condition: str, broken_by: str | None = None) -> DataFrame:
    """doc_id, tree_id, a and b (their st) of the pairs that the condition relates."""
    a, b = nodes.alias("a"), nodes.alias("b")
    found = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.tree_id") == F.col("b.tree_id")) & F.expr(condition))
    if broken_by is not None:
        x = nodes.alias("x")
        found = found.join(x, (F.col("x.doc_id") == F.col("a.doc_id")) & (F.col("x.tree_id") == F.col("a.tree_id")) & F.expr(broken_by), "left_anti")
    return found.select(F.col("a.doc_id").alias("doc_id"), F.col("a.tree_id").alias("tree_id"), F.col("a.st").alias("a"), F.col("b.st").alias("b"))


def axis(nodes: DataFrame, name: str, n: int | None = None, category: str | None = None, placed: bool = False) -> DataFrame:
    """Pairs of an axis by name. n: for the counting axes. category: SQL over x.label for the unbroken ones. placed: the nodes are those of ``nodes_of``."""
    if name in WAYS:
        over, conditions = WAYS[name]
        fits = f"coalesce({category.replace('x.label', 'label')}, false)" if category else "false"
        if placed and name in OF_HEADS:
            found = structural_join(nodes, chosen=F.col("head_st"), placed=True)
        else:
            found = structural_join(nodes, **{k: F.expr(c.replace("{c}", fits)) for k, c in conditions.items()}, placed=placed)
        return found if over else found.select(*TREE, F.col("b").alias("a"), F.col("a").alias("b"))
    # a missing document equals none
    nodes = nodes if name in ("unbroken_precedes", "unbroken_follows") else nodes.where("doc_id IS NOT NULL")
    if placed and name in OF_HEADS:
        a, b = ("head_st", "st") if name == "immediately_heads" else ("st", "head_st")
        return nodes.where("head_st IS NOT NULL").select(*TREE, F.col(a).alias("a"), F.col(b).alias("b"))
    if name in FAMILY:
        return of_children(nodes, *FAMILY[name])
    if name in ("equals", "parent_equals"):
        own, by_parent = (F.struct(F.col(c).alias("a"), F.col("st").alias("b")) for c in ("st", "parent"))
        return nodes.select(*TREE, F.inline(F.array(own, by_parent) if name == "parent_equals" else F.array(own))).where("a IS NOT NULL")
    if name in ("immediate_left_sister_of", "immediate_right_sister_of"):
        after = F.col("next_st") if placed else F.lead("st").over(Window.partitionBy(*TREE, "parent").orderBy("ci"))
        a, b = ("st", "__after") if name == "immediate_left_sister_of" else ("__after", "st")
        return nodes.where("parent IS NOT NULL").withColumn("__after", after).where("__after IS NOT NULL").select(*TREE, F.col(a).alias("a"), F.col(b).alias("b"))
    if name in ("left_sister_of", "right_sister_of", "sister_of"):
        return sisters(nodes, name, placed)
    if name in ("immediately_precedes", "immediately_follows"):
        return touching(nodes, name == "immediately_follows", placed)
    if name in ("unbroken_precedes", "unbroken_follows"):
        return neighbour_chains(nodes, category, name.endswith("follows"), placed)
    if name in SIMPLE:
        return pairs(nodes, SIMPLE[name][1])
    numbered(name, n)  # refuses other names and numbers
    if name == "ancestor_of_ith_leaf":
        return over_leaf(nodes, n, placed)
    return of_children(nodes, name == "ith_child_of", f"ci = {n - 1}" if n > 0 else f"ci = sisters - {-n}")


def of_children(nodes: DataFrame, child_first: bool, condition: str) -> DataFrame:
    """Pairs of a child that fits and its parent, from the child's row."""
    a, b = ("st", "parent") if child_first else ("parent", "st")
    return nodes.where(f"parent IS NOT NULL AND ({condition})").select(*TREE, F.col(a).alias("a"), F.col(b).alias("b"))


def in_trees(nodes: DataFrame, columns: dict[str, Column], related, placed: bool, swap: bool = False) -> DataFrame:
    """Pairs of nodes of one tree, from a pass over whole trees, batch by batch.

    related: from the columns, as arrays by name, and the number of each node's tree (arrays of many trees) gives index pairs part
    by part. A task holds a batch and the tree that goes on in the next. swap: the second is a.
    """
    rows = in_order(nodes.select(*TREE, "st", F.col("parent").isNull().alias("root"), *(c.alias(n) for n, c in columns.items())), placed)
    kind, read = nodes.schema["doc_id"].dataType.simpleString(), ("st", *columns)

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in _with_end(batches):
            now = [x for x in (held, batch) if x is not None and len(x)]
            if not now:
                continue
            now = pa.Table.from_batches(now).combine_chunks().to_batches()[0]
            root = now.column("root").to_numpy(zero_copy_only=False)
            if batch is not None:
                # a tree's first row is its root
                last = int(np.flatnonzero(root)[-1])
                held, now, root = now.slice(last), now.slice(0, last), root[:last]
            if not len(now):
                continue
            arrays = {n: now.column(n).to_numpy(zero_copy_only=False) for n in read}
            for first, second in related(arrays, np.cumsum(root)):
                if len(first):
                    take, st = pa.array(first), arrays["st"].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([now.column("doc_id").take(take), now.column("tree_id").take(take), pa.array(st[first]), pa.array(st[second])], names=["doc_id", "tree_id", "first", "second"])

    a, b = ("second", "first") if swap else ("first", "second")
    return rows.mapInArrow(run, f"doc_id {kind}, tree_id int, first int, second int").select(*TREE, F.col(a).alias("a"), F.col(b).alias("b"))


def runs(low: np.ndarray, high: np.ndarray):
    """(index, place) of all places from low to below high of each index, in parts."""
    n = np.maximum(high - low, 0)
    total = np.cumsum(n)
    cuts = [0, *(np.flatnonzero(np.diff(total // PAIRS)) + 1).tolist(), len(n)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        part = n[x:y]
        yield np.repeat(np.arange(x, y), part), np.repeat(low[x:y], part) + np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)


def sisters(nodes: DataFrame, name: str, placed: bool = False) -> DataFrame:
    """Pairs of children of one parent: a family's nodes stand together, in order, in a stable sort by parent."""

    def related(of, tree):
        child = np.flatnonzero(of["up"] >= 0)
        key = tree[child] * (of["st"].max() + 2) + of["up"][child]
        by = np.argsort(key, kind="stable")
        child, key, at = child[by], key[by], np.arange(len(by))
        low = at + 1 if name == "left_sister_of" else np.searchsorted(key, key)
        high = at if name == "right_sister_of" else np.searchsorted(key, key, "right")
        for i, j in runs(low, high):
            other = i != j
            yield child[i[other]], child[j[other]]

    return in_trees(nodes, {"up": F.coalesce("parent", F.lit(-1)).cast("long")}, related, placed)


def touching(nodes: DataFrame, backwards: bool, placed: bool = False) -> DataFrame:
    """Pairs of a node and one that begins where it ends (or the other way)."""

    def related(of, tree):
        span = of["right_edge"].max() + 1
        begins = tree * span + of["left_edge"]
        by = np.argsort(begins, kind="stable")
        begins, ends = begins[by], tree * span + of["right_edge"]
        # a tree's last edge is no node's first
        for i, j in runs(np.searchsorted(begins, ends), np.searchsorted(begins, ends, "right")):
            yield i, by[j]

    return in_trees(nodes, {c: F.col(c).cast("long") for c in ("left_edge", "right_edge")}, related, placed, backwards)


def over_leaf(nodes: DataFrame, n: int, placed: bool = False) -> DataFrame:
    """Pairs of a node and its n-th leaf (from the end below 0): leaves stand in order, each at its place."""

    def related(of, tree):
        left, right, leaf = of["left_edge"], of["right_edge"], of["is_leaf"]
        place = left + (n - 1) if n > 0 else right + n
        i = np.flatnonzero(~leaf & (place >= left) & (place < right))
        span = right.max() + 1
        at = np.flatnonzero(leaf)
        yield i, at[np.searchsorted(tree[at] * span + left[at], tree[i] * span + place[i])]

    return in_trees(nodes, {"is_leaf": F.col("is_leaf")} | {c: F.col(c).cast("long") for c in ("left_edge", "right_edge")}, related, placed)


def reachable(first: np.ndarray, after: np.ndarray, size: int) -> list[int]:
    """For each position up to size, the positions that arcs lead to from it, itself included, as bits counted from it.

    Arcs go from first to after, which is larger; positions are filled once, from right to left.
    """
    reach = [1] * (size + 1)
    order = np.lexsort((after, -first))
    for p, q in zip(first[order].tolist(), after[order].tolist(), strict=True):
        reach[p] |= reach[q] << (q - p)
    return reach


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``runs`` in one part."""
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def reached(first: np.ndarray, after: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``reachable`` for the positions of many small trees at once, as (bounds, positions).

    A position is done when those that its arcs lead to are, so a round does all that wait for nothing more.
    """
    arcs = np.unique((first * (size + 1) + after)[first < after])
    first, after = np.divmod(arcs, size + 1)
    by_end = np.argsort(after, kind="stable")
    at = np.arange(size + 2)
    starts, ends = np.searchsorted(first, at), np.searchsorted(after[by_end], at)
    wait = np.diff(starts)
    low, high, have, kept = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64), 0, np.empty(2 * size + 2, np.int64)
    done = np.flatnonzero(wait == 0)
    while len(done):
        _, arc = expanded(starts[done], starts[done + 1])
        by, place = expanded(low[after[arc]], high[after[arc]])
        own, position = np.divmod(np.unique(np.append(done * (size + 1) + done, first[arc][by] * (size + 1) + kept[place])), size + 1)
        if have + len(own) > len(kept):
            kept = np.append(kept, np.empty(have + 2 * len(own), np.int64))
        kept[have : have + len(own)] = position
        low[done], high[done] = have + np.searchsorted(own, done), have + np.searchsorted(own, done, "right")
        have += len(own)
        _, into = expanded(ends[done], ends[done + 1])
        before = first[by_end[into]]
        np.subtract.at(wait, before, 1)
        done = np.unique(before[wait[before] == 0])
    _, place = expanded(low, high)
    return np.append(0, np.cumsum(high - low)), kept[place]


def neighbour_chains(nodes: DataFrame, category: str, backwards: bool = False, placed: bool = False) -> DataFrame:
    """a before b with only nodes of the category, edge to edge, between (or b before a).

    A task holds, for each position between leaves, the later positions that chains reach: of many small
    trees at once as lists, of a large tree as bits.
    """
    fits = F.expr(f"coalesce({category.replace('x.label', 'label')}, false)")

    def of_large(left, right, arc):
        """Index pairs (first, second) of the nodes of one tree, position by position."""
        reach = reachable(left[arc], right[arc], int(right.max(initial=0)))
        by_left = np.argsort(left, kind="stable")
        starts = np.searchsorted(left[by_left], np.arange(len(reach) + 1))
        for p in np.unique(right).tolist():
            bits = np.frombuffer(reach[p].to_bytes(reach[p].bit_length() // 8 + 1, "little"), np.uint8)
            ends = p + np.flatnonzero(np.unpackbits(bits, bitorder="little"))
            second = np.concatenate([by_left[starts[q] : starts[q + 1]] for q in ends.tolist()])
            first = np.flatnonzero(right == p)
            yield np.repeat(first, len(second)), np.tile(second, len(first))

    def of_small(left, right, arc):
        """The same of many trees, whose positions are numbered one tree after the other, part by part."""
        size = int(right.max())
        bounds, position = reached(left[arc], right[arc], size)
        by_left = np.argsort(left, kind="stable")
        starts = np.searchsorted(left[by_left], np.arange(size + 2))
        met = np.append(0, np.cumsum(np.diff(starts)[position]))
        total = np.cumsum((met[bounds[1:]] - met[bounds[:-1]])[right])
        cuts = [0, *(np.flatnonzero(np.diff(total // PAIRS)) + 1).tolist(), len(right)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            node, place = expanded(bounds[right[x:y]], bounds[right[x:y] + 1])
            i, j = expanded(starts[position[place]], starts[position[place] + 1])
            yield x + node[i], by_left[j]

    def related(of, tree):
        cuts = np.append(np.flatnonzero(np.diff(tree, prepend=-1)), len(tree))
        left, right, arc = of["left_edge"], of["right_edge"], of["arc"]
        most = np.maximum.reduceat(right, cuts[:-1])
        large = most > POSITIONS
        small = np.flatnonzero(~np.repeat(large, np.diff(cuts)))
        if len(small):
            # a tree's positions go from 0 to its last edge
            room = np.where(large, 0, most + 1)
            shift = np.repeat(np.cumsum(room) - room, np.diff(cuts))[small]
            for i, j in of_small(left[small] + shift, right[small] + shift, arc[small]):
                yield small[i], small[j]
        firsts, seconds, size = [], [], 0
        for t in np.flatnonzero(large).tolist():
            own = slice(cuts[t], cuts[t + 1])
            for one, two in of_large(left[own], right[own], arc[own]):
                firsts.append(one + cuts[t])
                seconds.append(two + cuts[t])
                size += len(one)
                if size > PAIRS:
                    yield np.concatenate(firsts), np.concatenate(seconds)
                    firsts, seconds, size = [], [], 0
        if firsts:
            yield np.concatenate(firsts), np.concatenate(seconds)

    return in_trees(nodes, {"arc": fits} | {c: F.col(c).cast("long") for c in ("left_edge", "right_edge")}, related, placed, backwards)


def _with_end(batches):
    yield from batches
    yield None
