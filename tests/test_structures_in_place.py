"""Heads, structures, kinds and spans worked out where forests lie are those of the windows, and nothing is sorted for them."""

import random

import __spark_entry__ as entry
import pytest
from lexforest import queries
from lexforest.operators import heads, patterns, properties, trees
from lexforest.plans import sca
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
NAMES = (*patterns.NAMED, *heads.KNOWN, "@VP", "@S", "X", "CONJP")


def grown(draw, depth):
    kids = [grown(draw, depth - 1) if depth and draw.random() < 0.8 else draw.choice(["that", "for", "w", "That", "(IN that)", "(CC and)", "(VBZ is)", "(, ,)", "(. .)", "()"]) for _ in range(draw.randint(1, 4))]
    return f"({draw.choice(NAMES) if draw.random() < 0.9 else ''} {' '.join(kids)})"


def forests():
    draw = random.Random(5)
    rows = [(i, "\n".join(f"(ROOT {grown(draw, draw.randint(1, 6))})" if draw.random() < 0.8 else grown(draw, 3) for _ in range(draw.randint(1, 3)))) for i in range(600)]
    return [*rows, *((1000 + i, f) for i, f in queries.FORESTS), (2000, None), (2001, ""), (2002, "(S (NP"), (2003, "(ROOT (()) (X a))")]


@pytest.fixture(scope="module")
def given(spark):
    df = spark.createDataFrame(forests(), "doc_id long, forest string").persist()
    return df, trees.shred(df).persist()


def same(got, want):
    want = want.persist()
    assert got.count() == want.count() > 0 and got.exceptAll(want.select(got.columns)).count() == 0


def test_structures_are_those_of_the_windows(given, monkeypatch):
    monkeypatch.setattr(trees, "TOKENS", 512)
    df, nodes = given
    flagged = patterns.flagged(nodes).persist()
    for name in patterns.PRIMITIVES:
        same(patterns.found_in_place(df, name), patterns.matches(flagged, (name,)).select("doc_id", "tree_id", "st"))
    counts = patterns.word_counts(df).join(patterns.counts(flagged), "doc_id", "left").na.fill(0)
    same(sca.counts(df), counts)


def test_heads_kinds_and_spans_are_those_of_the_windows(spark, given, monkeypatch):
    monkeypatch.setattr(trees, "WEIGHT", 64)
    df, nodes = given
    headed = heads.with_heads(nodes).where("n_kids > 0").select("doc_id", "tree_id", "st", "head_st", "head_label")
    same(queries.head_child(spark, None, lambda *_: df), headed)
    same(queries.tree_kinds(spark, None, lambda *_: df), properties.kinds(nodes))
    edged = nodes.select("doc_id", "tree_id", "st", *(F.col(c).cast("long").alias(c) for c in ("left_edge", "right_edge")))
    same(queries.tree_edges(spark, None, lambda *_: df), trees.spans(nodes, edged))


@pytest.mark.parametrize("name", ["sca_CP_docs", "sca_counts", "sca_inline_docs", "formula_custom_docs", "select_measures_docs", "head_child_docs", "tree_kinds_docs", "tree_edges_docs", "axis_heads_docs"])
def test_nothing_is_sorted_or_shuffled_after_the_texts(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "Window" not in plan and "Join" not in plan and plan.count("Exchange ") == 1
