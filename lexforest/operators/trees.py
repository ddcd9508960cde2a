"""Parse forests as interval-encoded node tables.

A node spans the token positions st..en of its bracket pair; a leaf has st = en.
a is an ancestor of d exactly if a.st < d.st and a.en > d.en. Everything is
windows over one partitioning by document, so a forest is shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import dealt

TOKEN = r"[()]|[^\s()]+"
TREE = ["doc_id", "tree_id"]


def bracket_tokens(forests: DataFrame) -> DataFrame:
    """doc_id, pos, tok and its neighbours prev and next, without empty pairs; dep is the depth after the token, after1 and after2 are what then follows."""
    toks = forests.select("doc_id", F.posexplode(F.regexp_extract_all("forest", F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    toks = toks.withColumns({"prev": F.lag("tok").over(w), "next": F.lead("tok").over(w)})
    empty = ((F.col("tok") == "(") & F.coalesce(F.col("next") == ")", F.lit(False))) | ((F.col("tok") == ")") & F.coalesce(F.col("prev") == "(", F.lit(False)))
    step = F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)
    return toks.where(~empty).withColumns({"dep": F.sum(step).over(w), "after1": F.lead("tok").over(w), "after2": F.lead("tok", 2).over(w)})


def unbalanced(forests: DataFrame) -> DataFrame:
    """doc_id and error of the documents whose brackets do not match."""
    ends = bracket_tokens(forests).groupBy("doc_id").agg(F.min("dep").alias("low"), F.max_by("dep", "pos").alias("last"))
    error = F.when(F.col("low") < 0, "extra right bracket").when(F.col("last") != 0, "incomplete tree")
    return ends.select("doc_id", error.alias("error")).where("error IS NOT NULL")


def shred(forests: DataFrame, partitioned: bool = False, family: bool = True) -> DataFrame:
    """Nodes of every balanced forest (doc_id, forest). partitioned: the forests are dealt out by doc_id already.
    family: False leaves out the columns from parent to next_label, and the windows that they need.

    doc_id, tree_id, st, en, label, lvl, parent, parent_label, ci (child index from 0, -1 for a root), sisters (children
    of the parent), youngest (no sister follows), prev_label, next_label (of sisters), is_leaf, pre (has one child, a leaf), word (that leaf's label), left_edge, right_edge
    (leaves before the node and up to its end). Unbalanced documents give no rows (see unbalanced).
    """
    toks = bracket_tokens(forests if partitioned else dealt(forests))
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    so_far, whole = by_pos.rowsBetween(Window.unboundedPreceding, 0), by_pos.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    opens, closes = F.col("tok") == "(", F.col("tok") == ")"
    word = ~opens & ~closes
    after = F.when(F.col("next").isin("(", ")"), F.col("after1")).otherwise(F.col("after2"))
    leaf = (opens & F.coalesce(after == ")", F.lit(False))) | (word & (F.col("dep") > 0))
    label = F.when(word, F.col("tok")).otherwise(F.when(opens & (F.col("next") != "("), F.col("next")))
    # a name goes with its bracket, and rows are narrow from here on
    toks = toks.where(~word | (F.col("prev") != "(") | F.col("prev").isNull()).select("doc_id", "pos", "dep", label.alias("label"), leaf.alias("is_leaf"), opens.alias("opened"), closes.alias("closes"))
    toks = toks.withColumns({
        "low": F.min("dep").over(whole), "end": F.last("dep").over(whole), "leaves": F.count_if("is_leaf").over(so_far),
        "tree_id": F.last(F.when(F.col("opened") & (F.col("dep") == 1), F.col("pos")), ignorenulls=True).over(so_far),
    }).where("low >= 0 AND end = 0").drop("low", "end")
    # inside a level openers and closers alternate
    opens, closes = F.col("opened"), F.col("closes")
    pair = Window.partitionBy("doc_id", "level", "bracket").orderBy("pos")
    close = F.when(opens, F.lead(F.struct("pos", "leaves")).over(pair)).otherwise(F.struct("pos", "leaves"))
    toks = toks.withColumn("bracket", opens | closes).withColumn("level", F.when(closes, F.col("dep") + 1).otherwise(F.col("dep")))
    toks = toks.withColumn("close", close).where(opens | F.col("is_leaf"))
    label = F.replace(F.replace("label", F.lit("-LRB-"), F.lit("(")), F.lit("-RRB-"), F.lit(")"))
    nodes = toks.select(
        "doc_id", "tree_id", F.col("pos").alias("st"), F.col("close.pos").alias("en"), label.alias("label"), F.when(opens, F.col("dep")).otherwise(F.col("dep") + 1).alias("lvl"),
        "opened", "is_leaf", (F.col("leaves") - F.col("is_leaf").cast("int")).alias("left_edge"), F.col("close.leaves").alias("right_edge"),
    )
    nodes = with_family(nodes) if family else nodes.drop("opened")
    tree = Window.partitionBy(*TREE).orderBy("st")
    first = F.first("left_edge").over(tree.rowsBetween(Window.unboundedPreceding, 0))
    nodes = nodes.withColumns({"st1": F.lead("st").over(tree), "st2": F.lead("st", 2).over(tree), "below": F.lead(F.struct("label", "right_edge")).over(tree), "before": first})
    inner = lambda st: F.coalesce(F.col(st) <= F.col("en"), F.lit(False))
    nodes = nodes.withColumn("pre", inner("st1") & ~inner("st2")).withColumn("word", F.when(F.col("pre"), F.col("below.label")))
    # unlabelled roots with one child, which then holds all their leaves, are no nodes; they are a tree's first rows
    bare = F.col("label").isNull() & ~F.col("is_leaf") & (F.col("below.right_edge") == F.col("right_edge"))
    root = F.min(F.when(~F.coalesce(bare, F.lit(False)), F.struct("st", "lvl"))).over(Window.partitionBy(*TREE))
    nodes = nodes.withColumn("root", root).where("st >= root.st")
    nodes = nodes.withColumns({"lvl": (F.col("lvl") - F.col("root.lvl") + 1).cast("int"), "left_edge": F.col("left_edge") - F.col("before"), "right_edge": F.col("right_edge") - F.col("before")})
    own = ()
    if family:
        root = F.col("lvl") == 1
        own = ("parent", "parent_label", "ci", "sisters", "youngest", "prev_label", "next_label")
        nodes = nodes.withColumns({c: F.when(~root, F.col(c)) for c in ("parent", "parent_label", "prev_label", "next_label")})
        nodes = nodes.withColumns({"ci": F.when(root, -1).otherwise(F.col("ci")), "youngest": root | F.col("youngest")})
    edges = (F.col(c).cast("int").alias(c) for c in ("left_edge", "right_edge"))
    return nodes.select("doc_id", "tree_id", "st", "en", "label", "lvl", *own, "is_leaf", "pre", "word", *edges)


def with_family(nodes: DataFrame) -> DataFrame:
    """nodes with parent, parent_label, ci, sisters, youngest, prev_label and next_label.

    An opener stands a second time among the nodes one level down: the last one met is the parent, and its
    children follow it without another node between them.
    """
    both = nodes.withColumn("mark", F.explode(F.when(F.col("opened"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    level = Window.partitionBy("doc_id", F.col("lvl") + F.col("mark")).orderBy("st", "mark")
    up = level.rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("seen", F.count_if(F.col("mark") == 0).over(up))
    sister = F.when(F.col("mark") == 0, F.struct("label"))
    both = both.withColumns({
        "over": F.last(F.when(F.col("mark") == 1, F.struct("st", "label", "seen")), ignorenulls=True).over(up),
        "before": F.lag(sister).over(level), "after": F.lead(sister).over(level),
    }).where("mark = 0").withColumn("over", F.when(F.col("lvl") > 1, F.col("over")))
    out = both.withColumns({
        "parent": F.col("over.st"), "parent_label": F.col("over.label"), "ci": (F.col("seen") - F.col("over.seen")).cast("int"), "youngest": F.col("after").isNull(),
        "prev_label": F.col("before.label"), "next_label": F.col("after.label"),
    }).drop("mark", "opened", "over", "seen", "before", "after")
    return out.withColumn("sisters", F.count("*").over(Window.partitionBy(*TREE, "parent")))


#: Columns of the node table besides doc_id, and their types.
COLUMNS = {
    "tree_id": "int", "st": "int", "en": "int", "label": "string", "lvl": "int", "parent": "int", "parent_label": "string", "ci": "int", "sisters": "long", "youngest": "boolean",
    "prev_label": "string", "next_label": "string", "is_leaf": "boolean", "pre": "boolean", "word": "string", "left_edge": "int", "right_edge": "int",
    "next_st": "int", "kids": "array<struct<st: int, label: string, pre: boolean>>",
}
#: Tokens whose nodes a task holds at once, besides those of one document.
TOKENS = 1 << 16
#: Weight of the rows that a task gives out at once, about.
WEIGHT = 1 << 20


@dataclass
class Nodes:
    """Nodes of some documents as arrays, for what is worked out from several of them. An index is a place in these arrays, -1 is none.

    parent, after (the next sister) and last (the last node below, or itself) are indexes, kid counts from 0 among its sisters, of
    which there are sisters; a node's descendants stand right behind it.
    """

    label: pa.Array
    st: np.ndarray
    parent: np.ndarray
    kid: np.ndarray
    sisters: np.ndarray
    after: np.ndarray
    last: np.ndarray
    is_leaf: np.ndarray
    pre: np.ndarray
    kept: dict = field(default_factory=dict)

    def once(self, f):
        """f of these nodes, worked out once."""
        if f not in self.kept:
            self.kept[f] = f(self)
        return self.kept[f]

    def codes(self, labels: tuple[str, ...], of: pa.Array | None = None) -> np.ndarray:
        """Place of each node's label among the labels, -1 for others and none."""
        return pc.fill_null(pc.index_in(self.label if of is None else of, value_set=pa.array(labels)), -1).to_numpy(zero_copy_only=False)

    @cached_property
    def children(self) -> np.ndarray:
        """All that have a parent, by parent and in order."""
        child = np.flatnonzero(self.parent >= 0)
        return child[np.argsort(self.parent[child], kind="stable")]

    @cached_property
    def n_kids(self) -> np.ndarray:
        return np.bincount(self.parent[self.children], minlength=len(self.parent))

    @cached_property
    def first(self) -> np.ndarray:
        """Where a node's children begin in ``children``."""
        return np.cumsum(self.n_kids) - self.n_kids

    def some_kid(self, flag: np.ndarray) -> np.ndarray:
        """Nodes of which a child has the flag."""
        out = np.zeros(len(flag), bool)
        out[self.parent[flag & (self.parent >= 0)]] = True
        return out

    def under(self, flag: np.ndarray) -> np.ndarray:
        """Nodes of which an ancestor has the flag."""
        at = np.flatnonzero(flag)
        step = np.bincount(at + 1, minlength=len(flag) + 1) - np.bincount(self.last[at] + 1, minlength=len(flag) + 1)
        return np.cumsum(step)[: len(flag)] > 0

    def over(self, flag: np.ndarray) -> np.ndarray:
        """Nodes of which a descendant has the flag."""
        met = np.append(0, np.cumsum(flag))
        return met[self.last + 1] > met[np.arange(len(flag)) + 1]


def places(nodes: Nodes, index: np.ndarray, rows: np.ndarray) -> pa.Array:
    """st of the indexed nodes, for the rows."""
    return pa.array(nodes.st[index[rows]].astype(np.int32), mask=index[rows] < 0)


def whole_parts(tokens: pa.Array, most: int):
    """(from, to) of documents that are cut up at once, of about as many tokens."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(tokens)]
    return zip(cuts, cuts[1:], strict=False)


def tokens_of(forests: DataFrame, partitioned: bool, *columns: Column) -> DataFrame:
    """doc_id, tokens and the columns of forests; partitioned: they are dealt out by doc_id already."""
    return (forests if partitioned else dealt(forests)).select("doc_id", F.regexp_extract_all("forest", F.lit(TOKEN), F.lit(0)).alias("tokens"), *columns)


def shred_in_place(forests: DataFrame, *names: str, derived=None, chosen=None, weights=None, partitioned: bool = False) -> DataFrame:
    """doc_id and the named columns of ``shred``, next_st (the next sister's st) and kids (array of st, label, pre) among them.

    A document's brackets are matched where its text lies, some documents at a time, and its nodes are given out at once. So
    neither tokens nor nodes are sorted or kept: the rows of a document lie together in one task, sorted by st. Spark
    does not know this, so windows over them would shuffle them again; what goes on in one pass over sorted nodes need not.

    derived: name -> (type, function of Nodes and the indexes of rows that gives a column of these). chosen: function of Nodes
    that gives a flag, without which a node is left out. weights: function of Nodes that gives the size of each row, where rows are long.
    """
    derived = derived or {}

    def run(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            for x, y in whole_parts(tokens, TOKENS):
                for doc, rows in nodes_of(tokens.slice(x, y - x), names, derived, chosen, weights, WEIGHT):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc + x)), *rows], names=["doc_id", *names, *derived])

    kind = forests.schema["doc_id"].dataType.simpleString()
    types = {c: COLUMNS[c] for c in names} | {c: kind for c, (kind, _) in derived.items()}
    return tokens_of(forests, partitioned).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} {k}' for c, k in types.items())}")


def nodes_of(tokens: pa.Array, names: tuple[str, ...], derived=None, chosen=None, weights=None, most: int = 1):
    """Parts of (index of the node's document, columns), from a list a document of its tokens; see ``shred_in_place``.

    Inside a level openers and closers alternate, and sisters stand next to each other; so two stable sorts by level
    give each bracket its end and each node its family.
    """
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    flat, doc = tokens.flatten(), np.repeat(np.arange(len(sizes)), sizes)
    opens, closes = (pc.equal(flat, c).to_numpy(zero_copy_only=False) for c in "()")

    def ahead(flag, of, n=1):
        """The flag n places later in the same document."""
        out = np.zeros(len(flag), bool)
        out[:-n] = flag[n:] & (of[n:] == of[:-n])
        return out

    named = ahead(~opens & ~closes, doc)
    after_open = ahead(opens[::-1], doc[::-1])[::-1]
    k = np.flatnonzero(~((opens & ahead(closes, doc)) | (closes & after_open)))  # empty pairs are no nodes
    own, o, c = doc[k], opens[k], closes[k]
    step = o.astype(np.int64) - c
    total = np.bincount(own, step, len(sizes)).astype(np.int64)
    dep = np.cumsum(step) - (np.cumsum(total) - total)[own]
    low = np.zeros(len(sizes), np.int64)
    np.minimum.at(low, own, dep)
    leaf = (o & np.where(named[k], ahead(c, own, 2), ahead(c, own))) | (~o & ~c & (dep > 0))
    # a name goes with its bracket
    rows = ((low >= 0) & (total == 0))[own] & (o | c | ~after_open[k])
    k, own, o, c, dep, leaf = (x[rows] for x in (k, own, o, c, dep, leaf))

    leaves, close = np.cumsum(leaf), np.arange(len(k))
    pairs = np.flatnonzero(o | c)
    pairs = pairs[np.argsort((dep + c)[pairs], kind="stable")]
    close[pairs[::2]] = pairs[1::2]
    tree = np.maximum.accumulate(np.where(o & (dep == 1), np.arange(len(k)), -1))
    x = np.flatnonzero(o | leaf)
    opened, is_leaf, lvl, end, n = o[x], leaf[x], dep[x] + ~o[x], close[x], len(x)
    left, right, at = leaves[x] - is_leaf, leaves[end], np.arange(n)
    labelled = ~opened | named[k[x]]
    inner = [np.append(x[i:], np.full(min(i, n), len(k))) <= end for i in (1, 2)]
    pre = inner[0] & ~inner[1]
    # unlabelled roots with one child, which then holds all their leaves, are no nodes; they are a tree's first rows
    bare = ~labelled & ~is_leaf & (np.append(right[1:], -1)[:n] == right)
    first = np.diff(tree[x], prepend=-1) != 0
    of_tree = np.cumsum(first) - 1
    root = np.minimum.reduceat(np.where(bare, n, at), np.flatnonzero(first))[of_tree] if n else at
    before = left[np.flatnonzero(first)][of_tree]

    # a node's parent is the last opener before it one level up
    by = np.argsort(lvl, kind="stable")
    up = by[opened[by]]
    over = np.searchsorted(lvl[up] * n + up, (lvl - 1) * n + at) - 1
    parent = np.where((lvl > 1) & (at > root), up[over], -1) if len(up) else np.full(n, -1)
    family = np.where(lvl > 1, up[over], -1)[by] if len(up) else parent
    new = np.diff(family, prepend=-1) != 0
    new |= family < 0
    starts = np.flatnonzero(new)
    count, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    count[by] = np.diff(np.append(starts, n))[np.cumsum(new) - 1]
    rank[by] = np.arange(n) - starts[np.cumsum(new) - 1]
    beside = {}
    for name, has, near in (("prev_label", rank > 0, np.roll(by, 1)), ("next_label", rank < count - 1, np.roll(by, -1))):
        sister = np.empty(n, np.int64)
        sister[by] = near
        beside[name] = np.where(has & (at > root), sister, -1)

    stay = np.flatnonzero(at >= root)
    is_root = (at == root)[stay]
    place = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[doc]
    label = None
    if {"label", "parent_label", "prev_label", "next_label", "word", "kids"} & set(names) or derived or chosen or weights:
        label = flat.take(pa.array(k[x] + opened, mask=~labelled))
        for mark, bracket in (("-LRB-", "("), ("-RRB-", ")")):
            label = pc.replace_substring(label, mark, bracket)
    spelled = lambda i: label.take(pa.array(i[stay], mask=i[stay] < 0))
    ints = lambda v: pa.array(v.astype(np.int32))
    indexed = lambda i: pa.array(place[k[x[i[stay]]]].astype(np.int32), mask=i[stay] < 0)

    def kids():
        child = np.flatnonzero(parent >= 0)
        child = child[np.argsort(parent[child], kind="stable")]
        bounds = np.append(0, np.cumsum(np.bincount(parent[child], minlength=n)[stay])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([ints(place[k[x[child]]]), label.take(pa.array(child)), pa.array(pre[child])], ["st", "label", "pre"]))

    def whole() -> Nodes:
        index = lambda i: np.where(i[stay] >= 0, (np.cumsum(at >= root) - 1)[i[stay]], -1)
        return Nodes(spelled(at), place[k[x[stay]]], index(parent), np.where(is_root, 0, rank[stay]), count[stay], index(beside["next_label"]), np.searchsorted(x[stay], end[stay], "right") - 1, is_leaf[stay], pre[stay])

    columns = {
        "tree_id": lambda: ints(place[k[tree[x[stay]]]]), "st": lambda: ints(place[k[x[stay]]]), "en": lambda: ints(place[k[end[stay]]]), "label": lambda: spelled(at),
        "lvl": lambda: ints((lvl - lvl[root] + 1)[stay]), "parent": lambda: indexed(parent), "parent_label": lambda: spelled(parent),
        "ci": lambda: ints(np.where(is_root, -1, rank[stay])), "sisters": lambda: pa.array(count[stay]), "youngest": lambda: pa.array(is_root | (rank == count - 1)[stay]),
        "prev_label": lambda: spelled(beside["prev_label"]), "next_label": lambda: spelled(beside["next_label"]), "is_leaf": lambda: pa.array(is_leaf[stay]), "pre": lambda: pa.array(pre[stay]),
        "word": lambda: spelled(np.where(pre, at + 1, -1)), "next_st": lambda: indexed(beside["next_label"]), "kids": lambda: kids(), "left_edge": lambda: ints((left - before)[stay]), "right_edge": lambda: ints((right - before)[stay]),
    }
    nodes = whole() if derived or chosen or weights else None
    rows = np.arange(len(stay)) if chosen is None else np.flatnonzero(chosen(nodes))
    given = [columns[c]() for c in names]
    heavy = np.cumsum(weights(nodes)[rows]) if weights else np.zeros(len(rows), int)
    cuts = [0, *(np.flatnonzero(np.diff(heavy // most)) + 1).tolist(), len(rows)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = rows[low:high]
        yield own[x[stay[part]]], [*(c if len(part) == len(stay) else c.take(pa.array(part)) for c in given), *(f(nodes, part) for _, f in (derived or {}).values())]


def from_children(nodes: DataFrame, **aggregates: Column) -> DataFrame:
    """nodes with each name: the aggregate over the node's children (null or empty without any).

    A node stands once among its sisters and once at the head of its children, so a window
    by family brings the children's values up without a join or another shuffle. A node known
    to have no children (a column __childless) needs no second row.
    """
    family = Window.partitionBy(*TREE, F.when(F.col("__up"), F.col("st")).otherwise(F.col("parent")))
    twice = F.array(F.lit(False), F.lit(True))
    if "__childless" not in nodes.columns:
        both = nodes.withColumn("__up", F.explode(twice))
        return both.withColumns({n: a.over(family) for n, a in aggregates.items()}).where("__up").drop("__up")
    both = nodes.withColumn("__up", F.explode(F.when(F.col("__childless"), F.array(F.lit(False))).otherwise(twice)))
    both = both.withColumns({n: a.over(family) for n, a in aggregates.items()}).where("__up OR __childless")
    return both.withColumns({n: F.when(F.col("__up"), F.col(n)) for n in aggregates}).drop("__up")


def child(value: Column) -> Column:
    """value on children, null on the parent's own row."""
    return F.when(~F.col("__up"), value)


def inside(nodes: DataFrame, *flags: str) -> DataFrame:
    """nodes with below_<flag> (descendants that have it) and above_<flag> (ancestors that have it).

    Every node opens at st and closes at en. Running counts over these events give both numbers
    in linear space, however long a sentence is.
    """
    events = nodes.withColumn("__end", F.explode(F.array(F.lit(False), F.lit(True))))
    events = events.withColumn("__at", F.when(F.col("__end"), F.col("en")).otherwise(F.col("st")))
    run = Window.partitionBy(*TREE).orderBy("__at", "__end").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*TREE, "st")
    one = {f: F.col(f).cast("int") for f in flags}
    events = events.withColumns({f"__met_{f}": F.sum(F.when(F.col("__end"), 0).otherwise(c)).over(run) for f, c in one.items()} | {f"__open_{f}": F.sum(F.when(F.col("__end"), -c).otherwise(c)).over(run) for f, c in one.items()})
    events = events.withColumns({f"below_{f}": F.max(f"__met_{f}").over(own) - F.min(f"__met_{f}").over(own) for f in flags}).where("NOT __end")
    out = events.withColumns({f"above_{f}": F.col(f"__open_{f}") - c for f, c in one.items()})
    return out.drop("__end", "__at", *(f"__{k}_{f}" for k in ("met", "open") for f in flags))


def enclosed(nodes: DataFrame, above: tuple[str, ...] = (), below: tuple[str, ...] = ()) -> DataFrame:
    """nodes with under_<flag> (some ancestor has it) and over_<flag> (some descendant has it).

    Spans nest: a node that opened before and closes later is an ancestor, and the next node that has the
    flag is a descendant if it opens before this one closes. So a sort a direction is enough.
    """
    run = Window.partitionBy(*TREE).rowsBetween(Window.unboundedPreceding, -1)
    met = {f"under_{f}": F.coalesce(F.max(F.when(F.col(f), F.col("en"))).over(run.orderBy("st")) > F.col("st"), F.lit(False)) for f in above}
    out = nodes.withColumns(met) if met else nodes
    ahead = {f"over_{f}": F.coalesce(F.min(F.when(F.col(f), F.col("st"))).over(run.orderBy(F.desc("st"))) < F.col("en"), F.lit(False)) for f in below}
    return out.withColumns(ahead) if ahead else out


def spans(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (doc_id, tree_id, left_edge, right_edge, ...) with span, the leaves between the edges joined by blanks."""
    leaves = nodes.where("is_leaf").groupBy(*TREE).agg(F.transform(F.array_sort(F.collect_list(F.struct("st", "label"))), lambda x: x["label"]).alias("leaves"))
    own = F.slice("leaves", F.col("left_edge").cast("int") + 1, (F.col("right_edge") - F.col("left_edge")).cast("int"))
    return chosen.join(leaves, TREE).withColumn("span", F.array_join(own, " ")).drop("leaves")


def tagged_leaves(nodes: DataFrame, divider: str = "/") -> DataFrame:
    """doc_id, tree_id, st and word/TAG of every preterminal."""
    leaf = nodes.where("is_leaf").select(*TREE, F.col("parent").alias("st"), F.col("label").alias("word"))
    pre = nodes.where("pre").select(*TREE, "st", "label").join(leaf, [*TREE, "st"])
    return pre.select(*TREE, "st", F.concat_ws(divider, "word", "label").alias("tagged"))


def basic_category(label: Column) -> Column:
    """A label up to its first hyphen."""
    return F.split_part(label, F.lit("-"), F.lit(1))


def unshred(nodes: DataFrame) -> DataFrame:
    """doc_id and forest: the bracket text of the nodes, one tree a line (labels as normalised)."""
    opened = nodes.where("NOT is_leaf OR label IS NULL")
    # a childless bracket and a word are both leaves: both print as a word here
    start = nodes.select(*TREE, F.col("st").alias("at"), F.lit(0).alias("kind"), F.when(F.col("is_leaf"), F.col("label")).otherwise(F.concat(F.lit("("), F.coalesce("label", F.lit("")))).alias("txt"))
    end = opened.where("NOT is_leaf").select(*TREE, F.col("en").alias("at"), F.lit(1).alias("kind"), F.lit(")").alias("txt"))
    one = start.union(end).groupBy(*TREE).agg(F.array_sort(F.collect_list(F.struct("at", "kind", "txt"))).alias("parts"))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["txt"]), " "), r" \)", ")")
    per = one.select(*TREE, text.alias("tree"))
    return per.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tree_id", "tree"))), lambda x: x["tree"]), "\n").alias("forest"))
