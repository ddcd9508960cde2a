"""Folds over subtrees, lowest common ancestors and equality of subtrees, without an array a tree.

In the order of positions a subtree is one run of its tree's nodes. So a sum over every
subtree is a difference of running sums, a least or largest value over any run is the
answer of a sparse table (at index i and step k the best of 2^k nodes from i on), and
a subtree's identity is a difference of running polynomial sums of its tokens. Each takes windows within one
partitioning of the node table, and steps as many as the logarithm of the largest tree's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trees import TREE, child, from_children, inside

#: A prime whose residues multiply within 64 bits; and the bases of the running sums.
PRIME = 2**31 - 1
BASES = (1_000_003, 1_299_709, 1_442_695_041 % PRIME, 1_103_515_245, 69_069, 362_437_077)
#: Running sums that make an identity.
SUMS = 3


def numbered(nodes: DataFrame) -> DataFrame:
    """Adds i, a node's place in its tree from 0, and j, that of the last node below it (its own if there is none)."""
    placed = inside(nodes.withColumn("__one", F.lit(True)), "__one").drop("__one", "above___one")
    placed = placed.withColumn("i", F.row_number().over(Window.partitionBy(*TREE).orderBy("st")) - 1)
    return placed.withColumn("j", (F.col("i") + F.col("below___one")).cast("int")).drop("below___one")


def sparse_table(nodes: DataFrame, value: Column, least: bool = True) -> DataFrame:
    """Adds best, an array: at k the least (or largest) value of the 2^k nodes from the row on; nodes are numbered."""
    most = nodes.groupBy(*TREE).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    order, out = Window.partitionBy(*TREE).orderBy("i"), nodes.withColumn("__b0", value)
    pick = F.least if least else F.greatest
    steps = most.bit_length()
    for k in range(1, steps):
        out = out.withColumn(f"__b{k}", pick(f"__b{k - 1}", F.lead(f"__b{k - 1}", 1 << (k - 1)).over(order)))
    return out.withColumn("best", F.array(*(f"__b{k}" for k in range(steps)))).drop(*(f"__b{k}" for k in range(steps)))


def step_of(low: Column, high: Column) -> Column:
    """k, so that 2^k nodes from low and 2^k nodes up to high cover the run."""
    return F.floor(F.log2(high - low + 1)).cast("int")


def fold_sum(nodes: DataFrame, name: str, value: Column) -> DataFrame:
    """nodes with name: the sum of value over the node and all below it."""
    events = nodes.withColumn("__v", value).withColumn("__end", F.explode(F.array(F.lit(False), F.lit(True))))
    events = events.withColumn("__at", F.when(F.col("__end"), F.col("en")).otherwise(F.col("st")))
    run = Window.partitionBy(*TREE).orderBy("__at", "__end").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*TREE, "st")
    events = events.withColumn("__sum", F.sum(F.when(~F.col("__end"), F.col("__v")).otherwise(0)).over(run))
    at = lambda end: F.max(F.when(F.col("__end") == end, F.col("__sum"))).over(own)
    return events.withColumn(name, at(True) - at(False) + F.col("__v")).where("NOT __end").drop("__v", "__end", "__at", "__sum")


def fold_max(nodes: DataFrame, name: str, value: Column) -> DataFrame:
    """nodes with name: the largest value of the node and all below it."""
    table = sparse_table(numbered(nodes), value, least=False)
    table = table.withColumn("__k", step_of(F.col("i"), F.col("j")))
    last = table.select(*TREE, F.col("i").alias("__from"), F.col("best").alias("__best"))
    both = table.withColumn("__from", F.col("j") - F.call_function("shiftleft", F.lit(1), F.col("__k")) + 1).join(last, [*TREE, "__from"])
    return both.withColumn(name, F.greatest(F.get("best", F.col("__k")), F.get("__best", F.col("__k")))).drop("best", "__best", "__k", "__from", "i", "j")


def heights(nodes: DataFrame) -> DataFrame:
    """doc_id, tree_id, st and height of every node; a leaf has 1."""
    return fold_max(nodes.select(*TREE, "st", "en", "lvl"), "deepest", F.col("lvl")).select(*TREE, "st", (F.col("deepest") - F.col("lvl") + 1).alias("height"))


def num_edges(nodes: DataFrame) -> DataFrame:
    """doc_id, tree_id, st, edges and weight of every node.

    A leaf has 1 and 1. Another node has the sum of its children's edges and the largest of their
    weights; if its parent has several children, its weight is one more, and its edges are more by that weight.
    So a weight is 1 and the most such nodes on a way down to a leaf, and edges are the leaves and the weights of all such nodes.
    """
    forked = ~F.col("is_leaf") & F.col("parent").isNotNull() & (F.col("sisters") > 1)
    n = inside(nodes.select(*TREE, "st", "en", "is_leaf", forked.alias("forked")), "forked").drop("below_forked")
    n = fold_max(n, "most", F.when(F.col("is_leaf"), F.col("above_forked")).otherwise(0)).withColumn("weight", F.col("most") - F.col("above_forked") + 1)
    n = fold_sum(n, "edges", F.when(F.col("is_leaf"), 1).when(F.col("forked"), F.col("weight")).otherwise(0))
    return n.select(*TREE, "st", F.col("edges").cast("long").alias("edges"), F.col("weight").cast("long").alias("weight"))


def meetings(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, tree_id, a, b) with meet, the lowest node that has both (or is one of them), and the steps up from a and down to b.

    Of the nodes after the first of the two and up to the second, one of the least level is a child of the meeting node.
    """
    n = nodes.select(*TREE, "st", "lvl", "parent").withColumn("i", F.row_number().over(Window.partitionBy(*TREE).orderBy("st")) - 1)
    n = sparse_table(n, F.struct("lvl", "parent"))
    at = lambda x: n.select(*TREE, F.col("st").alias(x), F.col("i").alias(f"i_{x}"), F.col("lvl").alias(f"lvl_{x}"))
    both = pairs.join(at("a"), [*TREE, "a"]).join(at("b"), [*TREE, "b"])
    both = both.withColumns({"low": F.least("i_a", "i_b") + 1, "high": F.greatest("i_a", "i_b")}).withColumn("k", step_of(F.least("low", "high"), F.col("high")))
    side = lambda x: n.select(*TREE, F.col("i").alias(x), F.col("best").alias(f"best_{x}"))
    # a node meets itself: its run is empty, and any run serves
    both = both.withColumn("low", F.least("low", "high")).withColumn("back", F.col("high") - F.call_function("shiftleft", F.lit(1), F.col("k")) + 1)
    both = both.join(side("low"), [*TREE, "low"]).join(side("back"), [*TREE, "back"])
    top = F.least(F.get("best_low", F.col("k")), F.get("best_back", F.col("k")))
    same = F.col("a") == F.col("b")
    level = F.when(same, F.col("lvl_a")).otherwise(top["lvl"] - 1)
    return both.select(*TREE, "a", "b", F.when(same, F.col("a")).otherwise(top["parent"]).alias("meet"), (F.col("lvl_a") - level).cast("int").alias("up"), (F.col("lvl_b") - level).cast("int").alias("down"))


def power(base: int, exponent: Column) -> Column:
    """base to a power below 2^36, modulo PRIME: a factor for each six bits of the exponent."""
    out = F.lit(1).cast("long")
    for k in range(0, 36, 6):
        factors = F.expr("array({})".format(", ".join(f"{pow(base, d << k, PRIME)}L" for d in range(64))))
        out = out * F.get(factors, F.shiftright(exponent.cast("long"), k).bitwiseAND(F.lit(63)).cast("int")) % PRIME
    return out


def identities(nodes: DataFrame, first: int = 0) -> DataFrame:
    """nodes with same, an array of numbers that equal subtrees share and others hardly ever do.

    A tree is read as its tokens: an opening bracket with a label, a leaf's label, a closing bracket. With
    x(t) a number of the token at place t, sum x(t) b^t runs over the tree; a subtree's part of it, times b^-place, does not
    depend on where it stands.
    """
    events = nodes.withColumn("__end", F.explode(F.when(F.col("is_leaf"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    events = events.withColumn("__at", F.when(F.col("__end"), F.col("en")).otherwise(F.col("st")))
    run = Window.partitionBy(*TREE).orderBy("__at", "__end").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*TREE, "st")
    events = events.withColumn("__t", F.row_number().over(run))
    token = lambda k: F.pmod(F.xxhash64(F.lit(k), "is_leaf", F.when(F.col("__end"), F.lit(")")).otherwise(F.coalesce(F.concat(F.lit("("), "label"), F.lit("")))), F.lit(PRIME - 1)) + 1
    names = []
    for k in range(first, first + SUMS):
        base = BASES[k % len(BASES)]
        events = events.withColumn(f"__x{k}", token(k) * power(base, F.col("__t")) % PRIME)
        events = events.withColumn(f"__s{k}", F.sum(f"__x{k}").over(run))
        names.append((k, base))
    start = F.min("__t").over(own)
    found = {}
    for k, base in names:
        part = F.max(f"__s{k}").over(own) - F.min(F.col(f"__s{k}") - F.when(F.col("__end"), 0).otherwise(F.col(f"__x{k}"))).over(own)
        found[f"__r{k}"] = part % PRIME
    events = events.withColumns(found | {"__start": start}).where("NOT __end")
    same = F.array(*(F.col(f"__r{k}") * power(base, F.lit(PRIME - 1) - F.col("__start")) % PRIME for k, base in names))
    return events.withColumn("same", same).drop("__end", "__at", "__t", "__start", *(f"__{x}{k}" for x in "xsr" for k, _ in names))


def mistaken(known: DataFrame) -> int:
    """How many identities stand for unequal subtrees: nodes that share one must share label and the identities of their children in order.

    By induction on height that is enough, and it looks at every node once.
    """
    n = from_children(known, kids=F.collect_list(child(F.struct("st", "same")))).withColumn("kids", F.array_sort("kids"))
    sign = F.struct("is_leaf", F.coalesce("label", F.lit("")).alias("label"), F.transform("kids", lambda x: x["same"]).alias("kids"))
    return n.select("same", sign.alias("sign")).groupBy("same").agg(F.min("sign").alias("low"), F.max("sign").alias("high")).where("low <> high").count()


def equal_subtrees(nodes: DataFrame) -> DataFrame:
    """doc_id, tree_id, st and n: for every different subtree of more than a leaf where it stands first, and how often it stands in the corpus.

    Should two unequal subtrees share an identity, others are tried; no text is compared.
    """
    for attempt in range(4):
        known = identities(nodes.select(*TREE, "st", "en", "parent", "label", "is_leaf"), attempt * SUMS)
        if not mistaken(known):
            found = known.where("NOT is_leaf").groupBy("same").agg(F.min(F.struct(*TREE, "st")).alias("first"), F.count("*").alias("n"))
            return found.select("first.*", "n")
    raise ArithmeticError("unequal subtrees share an identity in every attempt")
