"""Folds, meetings, equality, head chains and slices against walks over small and deep trees."""

import random
from collections import Counter

import pytest
from lexforest.operators import axes, folds, heads, properties, structural, trees
from lexforest.queries import FORESTS
from pyspark.sql import functions as F


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return f"({rng.choice('AB')} {rng.choice('xy')})"
    return f"({rng.choice(['NP', 'VP', 'S', 'PP'])} {' '.join(random_tree(rng, depth - 1) for _ in range(rng.randint(1, 3)))})"


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(4)
    deep = "(S (NP x) " * 300 + "(VP y)" + ")" * 300
    rows = [*FORESTS, (50, " ".join(random_tree(rng, 4) for _ in range(12))), (51, " ".join(random_tree(rng, 5) for _ in range(5))), (52, deep), (53, "(ROOT " + "(X " * 1100 + "z" + ")" * 1101), (54, ""), (55, None)]
    return trees.shred(spark.createDataFrame(rows, "doc_id long, forest string").repartition(4)).persist()


@pytest.fixture(scope="module")
def forest(nodes):
    """(doc_id, tree_id) -> st -> row with kids, in order."""
    out = {}
    for r in sorted(nodes.collect(), key=lambda r: (r.doc_id, r.st)):
        tree = out.setdefault((r.doc_id, r.tree_id), {})
        tree[r.st] = (r, [])
        if r.parent is not None:
            tree[r.parent][1].append(r.st)
    return out


def test_num_edges(nodes, forest):
    got = {(r.doc_id, r.st): (r.edges, r.weight) for r in folds.num_edges(nodes).collect()}
    want = {}
    for (doc, _), tree in forest.items():
        for st in sorted(tree, reverse=True):  # children come first
            r, kids = tree[st]
            if not kids:
                want[doc, st] = (1, 1)
                continue
            n, w = sum(want[doc, k][0] for k in kids), max(want[doc, k][1] for k in kids)
            if r.parent is not None and len(tree[r.parent][1]) != 1:
                w += 1
                n += w
            want[doc, st] = (n, w)
    assert got == want
    assert max(w for _, w in want.values()) > 300


def test_heights_and_sums(nodes, forest):
    height, size = {}, {}
    for (doc, _), tree in forest.items():
        for st in sorted(tree, reverse=True):
            kids = tree[st][1]
            height[doc, st] = 1 + max((height[doc, k] for k in kids), default=0)
            size[doc, st] = 1 + sum(size[doc, k] for k in kids)
    assert {(r.doc_id, r.st): r.height for r in folds.heights(nodes).collect()} == height
    assert {(r.doc_id, r.st): r.total for r in folds.fold_sum(nodes, "total", F.lit(1)).collect()} == size


def test_meetings(spark, nodes, forest):
    rng = random.Random(2)
    asked, want = [], set()
    for (doc, tree_id), tree in forest.items():
        way = {}
        for st in sorted(tree):
            way[st] = [st, *(way[tree[st][0].parent] if tree[st][0].parent is not None else [])]
        for _ in range(30):
            a, b = rng.choice(list(tree)), rng.choice(list(tree))
            if (doc, tree_id, a, b) not in asked:
                asked.append((doc, tree_id, a, b))
                meet = next(x for x in way[a] if x in set(way[b]))
                want.add((doc, a, b, meet, way[a].index(meet), way[b].index(meet)))
    got = folds.meetings(nodes, spark.createDataFrame(asked, "doc_id long, tree_id int, a int, b int")).collect()
    assert {(r.doc_id, r.a, r.b, r.meet, r.up, r.down) for r in got} == want and len(got) == len(asked)


def test_equal_subtrees(nodes, forest, monkeypatch):
    code, first, n = {}, {}, Counter()
    for (doc, tree_id), tree in sorted(forest.items()):
        own = {}
        for st in sorted(tree, reverse=True):
            r, kids = tree[st]
            sign = (r.is_leaf, r.label, tuple(own[k] for k in kids))
            own[st] = code.setdefault(sign, len(code))
        for st in sorted(tree):
            if not tree[st][0].is_leaf:
                n[own[st]] += 1
                first.setdefault(own[st], (doc, tree_id, st))
    want = {(*first[c], k) for c, k in n.items()}
    assert {tuple(r) for r in folds.equal_subtrees(nodes).collect()} == want
    # sums modulo a small prime collide, which is noticed
    monkeypatch.setattr(folds, "PRIME", 7)
    monkeypatch.setattr(folds, "SUMS", 1)
    assert folds.mistaken(folds.identities(nodes.select("doc_id", "tree_id", "st", "en", "parent", "label", "is_leaf"))) > 0
    with pytest.raises(ArithmeticError):
        folds.equal_subtrees(nodes)


def test_structural_join_carries_open_nodes(spark, forest, nodes):
    """Batches that end inside a tree, and conditions on both ends and on the way."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = Counter((r.doc_id, r.a, r.b) for r in structural.structural_join(nodes.where("doc_id < 52"), leave=F.col("label") != "PP", through=F.col("label") != "S", upper=F.col("label").isin("NP", "S", "VP"), lower=F.col("lvl") > 2).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = Counter()
    for (doc, _), tree in forest.items():
        for st in tree if doc < 52 else ():
            if tree[st][0].lvl <= 2:
                continue
            at = st
            while (p := tree[at][0].parent) is not None and tree[at][0].label not in ("PP", None) and (at == st or tree[at][0].label != "S"):
                if tree[p][0].label in ("NP", "S", "VP"):
                    want[doc, p, st] += 1
                at = p
    assert got == want and len(got) > 100


def test_head_words(nodes):
    n = axes.axis_nodes(heads.with_heads(nodes.where("doc_id <> 53")))
    rows = {(r.doc_id, r.st): r for r in n.collect()}
    got = {(r.doc_id, r.st): r.word for r in properties.head_words(n).collect()}
    for (doc, st), r in rows.items():
        while r is not None and not r.is_leaf:
            r = rows.get((doc, r.head_st))
        assert got.get((doc, st)) == (r.label if r is not None else None)


@pytest.mark.parametrize("at", [0, -1, 2, slice(None), slice(1, None), slice(None, -1), slice(-2, None), slice(None, None, 2), slice(None, None, -1), slice(-1, 0, -2), slice(5, 1), slice(-9, 9, 3)])
def test_slices(nodes, forest, at):
    want = set()
    for (doc, _), tree in forest.items():
        for st, (_, kids) in tree.items():
            found = kids[at] if isinstance(at, slice) else kids[at : at + 1 or None]
            want |= {(doc, st, k) for k in found}
    assert {(r.doc_id, r.st, r.node) for r in properties.item(nodes, [at]).collect()} == want
