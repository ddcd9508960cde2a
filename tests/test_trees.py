"""Trees against small recursive definitions written here."""

import pytest
from lexforest.operators import axes, heads, patterns, trees
from lexforest.plans import sca
from lexforest.queries import FORESTS
from pyspark.sql import functions as F

ODD = [
    (20, "(S (NP a) () (VP b)"),
    (21, "junk (( (X y) z (FRAG))) tail (A -LRB- b)"),
    (22, None),
    (23, ""),
    (24, "(A b))"),
    (25, "((((S (NP x)))))"),
]


def parse(text):
    """Nodes as (label, children) of each tree; a leaf has no children."""
    import re

    out, stack, toks, i = [], [], re.findall(r"[()]|[^\s()]+", text), 0
    while i < len(toks):
        t = toks[i]
        if t == "(":
            if toks[i + 1] == ")":
                i += 2
                continue
            label = None
            if toks[i + 1] != "(":
                label, i = toks[i + 1], i + 1
            stack.append((label, []))
        elif t == ")":
            node = stack.pop()
            (stack[-1][1] if stack else out).append(node)
        elif stack:
            stack[-1][1].append((t, []))
        i += 1

    def strip(n):
        return strip(n[1][0]) if n[0] is None and len(n[1]) == 1 else n

    return [strip(n) for n in out]


@pytest.fixture(scope="module")
def nodes(spark):
    return trees.shred(spark.createDataFrame(FORESTS, "doc_id long, forest string")).persist()


def test_shred_matches_recursive_parser(spark, nodes):
    got = {}
    for r in nodes.orderBy("doc_id", "st").collect():
        got.setdefault(r.doc_id, []).append((r.label, r.lvl, r.ci, r.is_leaf, r.parent_label))

    def flat(n, lvl=1, ci=-1, parent=None):
        yield (n[0], lvl, ci, not n[1], parent)
        for k, c in enumerate(n[1]):
            yield from flat(c, lvl + 1, k, n[0])

    for doc, text in FORESTS:
        assert got[doc] == [x for t in parse(text) for x in flat(t)]


def test_odd_forests(spark):
    df = spark.createDataFrame(ODD, "doc_id long, forest string")
    got = trees.shred(df).groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("st", "label"))).alias("l")).collect()
    labels = {r.doc_id: [x.label for x in r.l] for r in got}
    assert labels[21] == [None, "X", "y", "z", "FRAG", "A", "(", "b"]
    assert labels[25] == ["S", "NP", "x"]
    assert set(labels) == {21, 25}
    errors = {r.doc_id: r.error for r in trees.unbalanced(df).collect()}
    assert errors == {20: "incomplete tree", 24: "extra right bracket"}
    counted = {r.doc_id: r.W for r in sca.counts(df).collect()}
    # a token with a dash, as a bracket's name, is no word
    assert counted == {20: 2, 21: 1, 22: 0, 23: 0, 24: 1, 25: 1}


def test_edges_and_dominance(nodes):
    n = axes.axis_nodes(heads.with_heads(nodes)).persist()
    kids = {(r.doc_id, r.st): r.parent for r in n.collect()}

    def ancestors(doc, st):
        while kids[doc, st] is not None:
            st = kids[doc, st]
            yield st

    want = {(doc, a, st) for doc, st in kids for a in ancestors(doc, st)}
    assert {(r.doc_id, r.a, r.b) for r in axes.axis(n, "dominates").collect()} == want
    heads_of = {(r.doc_id, r.a, r.b) for r in axes.axis(n, "headed_by").collect()}
    head = {(r.doc_id, r.st): r.head_st for r in n.collect()}
    chain = set()
    for doc, st in head:
        h = head[doc, st]
        while h is not None:
            chain.add((doc, st, h))
            h = head[doc, h]
    assert heads_of == chain
    with pytest.raises(ValueError):
        axes.axis(n, "ith_child_of", 0)


def test_structures(spark):
    rows = {r.doc_id: r for r in sca.counts(spark.createDataFrame(FORESTS, "doc_id long, forest string")).collect()}
    # the outer clause has no verb phrase of its own, and the first inner one no sister before it
    assert (rows[3].T1, rows[3].C1, rows[3].S) == (2, 2, 1)
    assert rows[7].T2 == 2 and rows[7].C2 == 1
    assert rows[5].CN2 == 2 and rows[5].DC == 2
    assert rows[6].CN3 == 2
    assert rows[4].VP2 == 1 and rows[4].CP == 1
    assert {p: sum(getattr(r, p) for r in rows.values()) > 0 for p in patterns.PRIMITIVES} == dict.fromkeys(patterns.PRIMITIVES, True)


def test_round_trip(spark, nodes):
    again = trees.shred(trees.unshred(nodes))
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "label", "lvl", "ci", "left_edge", "right_edge").collect())
    assert key(again) == key(nodes)


def test_tree_queries_read_the_documents(spark, tmp_path):
    from lexforest import queries

    spark.createDataFrame([(71, "The dog ran and we saw it. He sat."), (72, "They know that she left.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.queries()
    for name in ("tree_shred_docs", "tree_heights_docs", "tree_edges_docs", "sca_matches_docs"):
        assert {r.doc_id for r in found[name](spark, str(tmp_path)).collect()} == {71, 72}, name
    for forests in (queries.inline, queries.of_documents):
        nodes = found["tree_shred_docs"](spark, str(tmp_path), forests=forests).collect()
        want = {(a.doc_id, a.st): 1 + max(d.lvl - a.lvl for d in nodes if (d.doc_id, d.tree_id) == (a.doc_id, a.tree_id) and a.st <= d.st <= a.en) for a in nodes}
        assert {(r.doc_id, r.st): r.height for r in found["tree_heights_docs"](spark, str(tmp_path), forests=forests).collect()} == want
