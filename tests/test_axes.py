"""Every axis against a walk over small trees, the structures against single trees, and deep trees."""

import pytest
from lexforest.operators import axes, folds, heads, patterns, predicates, properties, trees
from lexforest.plans import sca
from lexforest.queries import FORESTS
from pyspark.sql import functions as F

CATEGORY = ("NP", "VP", "S")


@pytest.fixture(scope="module")
def nodes(spark):
    df = spark.createDataFrame(FORESTS[:6] + FORESTS[8:9] + FORESTS[11:], "doc_id long, forest string")
    return axes.axis_nodes(heads.with_heads(trees.shred(df))).persist()


@pytest.fixture(scope="module")
def walked(nodes):
    """Trees of nodes linked by parent and children only."""

    class Node:
        def __init__(self, r):
            self.st, self.label, self.head_st, self.parent, self.kids = r.st, r.label, r.head_st, None, []

        def below(self):
            for k in self.kids:
                yield k
                yield from k.below()

        def leaves(self):
            return [self] if not self.kids else [x for k in self.kids for x in k.leaves()]

        def up(self):
            return [self.parent, *self.parent.up()] if self.parent else []

        def between(self, lower):
            """Nodes strictly between this one and one below it."""
            way = lower.up()
            return way[: way.index(self)]

        @property
        def head(self):
            return next((k for k in self.kids if k.st == self.head_st), None)

    out, parents = {}, {}
    for r in nodes.collect():
        n = Node(r)
        out.setdefault((r.doc_id, r.tree_id), {})[r.st] = n
        parents[n] = r.parent
    for tree in out.values():
        for st in sorted(tree):
            if parents[tree[st]] is not None:
                tree[st].parent = tree[parents[tree[st]]]
                tree[st].parent.kids.append(tree[st])
    return out


def sisters(n):
    return n.parent.kids if n.parent else []


def spine(n, k):
    return [n.kids[k], *spine(n.kids[k], k)] if n.kids else []


def chain(n):
    return [n.head, *chain(n.head)] if n.head else []


def unary(n):
    return [n.kids[0], *unary(n.kids[0])] if len(n.kids) == 1 else list(n.kids)


def leaf_numbers(n, root):
    order = root.leaves()
    own = [order.index(x) for x in n.leaves()]
    return own[0], own[-1] + 1


def top(n):
    return n.up()[-1] if n.up() else n


def follows_directly(a, b):
    return leaf_numbers(a, top(a))[1] == leaf_numbers(b, top(b))[0]


#: name -> whether a stands in the relation to b
WALKS = {
    "dominates": lambda a, b: a in b.up(),
    "only_child_of": lambda a, b: a.parent is b and len(b.kids) == 1,
    "last_child_of": lambda a, b: a.parent is b and b.kids[-1] is a,
    "leftmost_child_of": lambda a, b: a.parent is b and b.kids[0] is a,
    "has_rightmost_descendant": lambda a, b: b in spine(a, -1),
    "has_leftmost_descendant": lambda a, b: b in spine(a, 0),
    "left_sister_of": lambda a, b: b in sisters(a)[sisters(a).index(a) + 1 :] if a.parent else False,
    "immediate_left_sister_of": lambda a, b: b in sisters(a)[sisters(a).index(a) + 1 :][:1] if a.parent else False,
    "parent_of": lambda a, b: b in a.kids,
    "sister_of": lambda a, b: a is not b and b in sisters(a),
    "equals": lambda a, b: a is b,
    "parent_equals": lambda a, b: a is b or b in a.kids,
    "immediately_headed_by": lambda a, b: a.head is b,
    "precedes": lambda a, b: leaf_numbers(a, top(a))[1] <= leaf_numbers(b, top(b))[0],
    "immediately_precedes": follows_directly,
    "ancestor_of_leaf": lambda a, b: a in b.up() and not b.kids,
    "same_tree": lambda a, b: True,
    "unary_path_ancestor_of": lambda a, b: a in b.up() and b in unary_reach(a),
    "headed_by": lambda a, b: b in chain(a),
    "unbroken_dominates": lambda a, b: a in b.up() and all(x.label in CATEGORY for x in a.between(b)),
}
WALKS |= {
    "dominated_by": lambda a, b: WALKS["dominates"](b, a), "has_only_child": lambda a, b: WALKS["only_child_of"](b, a), "parent_of_last_child": lambda a, b: WALKS["last_child_of"](b, a),
    "has_leftmost_child": lambda a, b: WALKS["leftmost_child_of"](b, a), "rightmost_descendant_of": lambda a, b: WALKS["has_rightmost_descendant"](b, a), "leftmost_descendant_of": lambda a, b: WALKS["has_leftmost_descendant"](b, a),
    "right_sister_of": lambda a, b: WALKS["left_sister_of"](b, a), "immediate_right_sister_of": lambda a, b: WALKS["immediate_left_sister_of"](b, a), "child_of": lambda a, b: WALKS["parent_of"](b, a),
    "immediately_heads": lambda a, b: WALKS["immediately_headed_by"](b, a), "follows": lambda a, b: WALKS["precedes"](b, a), "immediately_follows": lambda a, b: follows_directly(b, a),
    "unary_path_descendant_of": lambda a, b: WALKS["unary_path_ancestor_of"](b, a), "heads": lambda a, b: WALKS["headed_by"](b, a), "unbroken_dominated_by": lambda a, b: WALKS["unbroken_dominates"](b, a),
}


def unary_reach(n):
    """Nodes below n by a way on which every node has one child, but the last."""
    return [n.kids[0], *unary_reach(n.kids[0])] if len(n.kids) == 1 else []


def pairs_of(walked, holds):
    return {(doc, a.st, b.st) for (doc, _), tree in walked.items() for a in tree.values() for b in tree.values() if holds(a, b)}


def test_all_axes_have_a_walk():
    assert set(WALKS) == {*axes.SIMPLE, *axes.PATHS}


def test_axes(nodes, walked):
    category = "x.label IN ('NP', 'VP', 'S')"
    for name, holds in WALKS.items():
        got = {(r.doc_id, r.a, r.b) for r in axes.axis(nodes, name, category=category).collect()}
        assert got == pairs_of(walked, holds), name


def test_counted_axes(nodes, walked):
    for n in (1, 2, -1, -2):
        at = n - 1 if n > 0 else n
        nth = lambda xs: xs[at] if -len(xs) <= at < len(xs) else None  # noqa: B023, E731
        for name, holds in (("has_ith_child", lambda a, b: nth(a.kids) is b), ("ith_child_of", lambda a, b: nth(b.kids) is a), ("ancestor_of_ith_leaf", lambda a, b: bool(a.kids) and nth(a.leaves()) is b)):
            assert {(r.doc_id, r.a, r.b) for r in axes.axis(nodes, name, n).collect()} == pairs_of(walked, holds), (name, n)


def test_searches(nodes):
    labels = {(r.doc_id, r.st): r.label for r in nodes.collect()}
    found = predicates.search(nodes, predicates.regex("^np (-|$)", "ix"), predicates.Related("headed_by", predicates.text("NN")), predicates.Related("has_ith_child", predicates.text("DT"), negated=True, n=1))
    got = sorted((r.doc_id, labels[r.doc_id, r.st]) for r in found.collect())
    assert got and all(x.startswith("NP") for _, x in got) and (1, "NP") not in got
    with pytest.raises(ValueError):
        predicates.regex("x", "g")


def deep(n, label="X"):
    return f"({label} " * n + "leaf" + ")" * n


def test_deep_trees(spark):
    df = spark.createDataFrame([(1, "(ROOT " + deep(1100) + ")"), (2, "(ROOT (S (NP (PRP it)) " + "(VP (VBD said) (SBAR (S (NP (PRP he)) " * 300 + "(VP (VBZ is))" + ")))" * 300 + "))")], "doc_id long, forest string")
    n = trees.shred(df).persist()
    assert n.where("doc_id = 1").agg(F.max("lvl"), F.count("*")).first()[:] == (1102, 1102)
    assert {r.doc_id: r.height for r in folds.heights(n).where("st = 0").collect()}[1] == 1102
    r = sca.counts(df.where("doc_id = 2")).first()
    assert (r.C1, r.DC, r.T1, r.VP1, r.CT) == (301, 300, 1, 301, 1)
    assert properties.kinds(n).where("doc_id = 1 AND NOT is_leaf AND NOT binary").count() == 1100


#: structure, tree, matches: pairs that differ in one condition
CASES = [
    ("S", "(ROOT (X a))", 1), ("S", "(TOP (ROOT a))", 0),
    ("VP1", "(S (VP (VB go)))", 1), ("VP1", "(SQ (VP (VB go)))", 1), ("VP1", "(SINV (VP (VB go)))", 1), ("VP1", "(SBAR (VP (VB go)))", 0), ("VP1", "(NP (VP (VB go)))", 0),
    ("VP2", "(SQ (MD can) (NP (PRP we)))", 1), ("VP2", "(SQ (VBZ is) (NP (PRP he)))", 1), ("VP2", "(SQ (VB be) (NP (PRP he)))", 0), ("VP2", "(SQ (MD can) (NP (PRP we)) (VP (VB go)))", 0), ("VP2", "(S (MD can))", 0),
    ("C1", "(ROOT (S (NP (PRP I)) (VP (VBP know))))", 1), ("C1", "(ROOT (S (NP (PRP I)) (VP (VBG going))))", 0), ("C1", "(ROOT (S (VP (VB go))))", 1), ("C1", "(X (S (VP (VB go))))", 0), ("C1", "(S (VP (VP (VBZ is)) (CC and) (VP (VBZ sits))))", 1), ("C1", "(S (VP (VP (VBG being)) (CC and) (VP (VBG sitting))))", 0),
    ("C2", "(ROOT (FRAG (NP (NN cat))))", 1), ("C2", "(ROOT (FRAG (S (NP (PRP I)) (VP (VBP know)))))", 0), ("C2", "(S (FRAG (NP (NN cat))))", 0),
    ("T1", "(ROOT (S (NP (PRP I)) (VP (VBP know))))", 1), ("T1", "(ROOT (S (S (VP (VBD ran))) (CC and) (S (VP (VBD sat)))))", 2), ("T1", "(ROOT (SBARQ (WP who)))", 1), ("T1", "(X (S (VP (VBD ran))))", 0), ("T1", "(ROOT (S (VP (SBAR (S (VP (VBD ran))) (S (VP (VBD sat)))))))", 1),
    ("T2", "(ROOT (FRAG (NP (NN cat))))", 1), ("T2", "(ROOT (FRAG (S (NP (NN cat)) (VP (VBD ran)))))", 1),
    ("DC", "(SBAR (IN that) (S (VP (VBD left))))", 1), ("DC", "(SBAR (IN that) (S (VP (TO to) (VP (VB go)))))", 0), ("DC", "(S (S (VP (VBD left))))", 0),
    ("CT", "(ROOT (S (VP (VBP know) (SBAR (S (VP (VBD left)))))))", 1), ("CT", "(ROOT (S (VP (VBP know) (SBAR (S (VP (VBG leaving)))))))", 0),
    ("CP", "(NP (NN cat) (CC and) (NN dog))", 1), ("CP", "(ADJP (JJ red) (CC and) (JJ big))", 1), ("CP", "(ADVP (RB now) (CC or) (RB then))", 1), ("CP", "(VP (VB go) (CC or) (VB stay))", 1), ("CP", "(PP (IN in) (CC or) (IN on))", 0), ("CP", "(NP (NN cat) (NN dog))", 0),
    ("CN1", "(NP (JJ old) (NN cat))", 1), ("CN1", "(NP (NN cat))", 0), ("CN1", "(NP (NP (NN cat)) (PP (IN of) (NP (NN war))))", 1), ("CN1", "(NP (NP (NN king) (POS 's)) (NN hat))", 1), ("CN1", "(NP (VBG running) (NNS shoes))", 1), ("CN1", "(NP (NP (NN cat)) (NP (NN dog)))", 1), ("CN1", "(NP (NP (NN cat)) (CC and) (NP (NN dog)))", 0),
    ("CN2", "(S (SBAR (WHNP (WP what)) (S (VP (VBD said)))) (VP (VBD hurt)))", 1), ("CN2", "(VP (VBP know) (SBAR (IN that) (S (VP (VBD left)))))", 1), ("CN2", "(VP (VBP go) (SBAR (IN as) (S (VP (VBD left)))))", 0), ("CN2", "(VP (VBP know) (SBAR (S (VP (VBD left)))))", 1), ("CN2", "(NP (NP (NN man)) (SBAR (WHNP (WDT that)) (S (VP (VBZ sings)))))", 0),
    ("CN3", "(S (S (VP (VBG running))) (VP (VBZ helps)))", 1), ("CN3", "(S (S (VP (TO to) (VP (VB err)))) (VP (VBZ is)))", 1), ("CN3", "(S (S (VP (VBD ran))) (VP (VBZ is)))", 0), ("CN3", "(S (S (VP (VBG running))) (NP (NN x)))", 0),
]


def test_structures_of_single_trees(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "doc_id long, forest string")
    got = {r.doc_id: r for r in sca.counts(df).collect()}
    wrong = [(i, name, t, want, getattr(got[i], name)) for i, (name, t, want) in enumerate(CASES) if getattr(got[i], name) != want]
    assert not wrong
    assert {n for n, _, _ in CASES} == set(patterns.PRIMITIVES)
