"""Nodes cut where their text lies are those of the windows, and axes over them keep no tokens or nodes for a sort."""

import random

import __spark_entry__ as entry
import pytest
from lexforest.operators import axes, trees
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def forests():
    draw, rows = random.Random(3), [(9001, None), (9002, ""), (None, "(A (B c) (D e))"), (9003, "((( (A b))) )"), (9004, "(A) (B) c ((D))"), (9005, "word only"), (9006, "()"), (9007, "(())")]
    for i in range(300):
        toks, depth = [], 0
        for _ in range(draw.randint(0, 40)):
            kind = draw.random()
            toks.append("(" if kind < 0.4 else ")" if kind < 0.7 and depth else draw.choice(["A", "NP", "-LRB-", "b", "x-RRB-y", "é"]))
            depth += {"(": 1, ")": -1}.get(toks[-1], 0)
        rows.append((i, " ".join(toks + [")"] * (depth if draw.random() < 0.9 else 0))))
    return rows


def test_nodes_are_those_of_the_windows(spark, monkeypatch):
    monkeypatch.setattr(trees, "TOKENS", 64)
    df = spark.createDataFrame(forests(), "doc_id long, forest string")
    names = [c for c in trees.COLUMNS if c not in ("next_st", "kids")]
    want, got = trees.shred(df).persist(), trees.shred_in_place(df, *names).persist()
    assert want.schema.simpleString() == got.schema.simpleString()
    assert want.count() == got.count() > 1000
    assert want.exceptAll(got).count() == 0


@pytest.mark.parametrize("name", ["child_of", "equals", "dominates", "heads", "immediately_headed_by", "immediate_right_sister_of", "immediately_follows", "ancestor_of_ith_leaf_last", "sister_of", "unbroken_follows"])
def test_no_axis_sorts_nodes(spark, name):
    plan = entry.queries()[f"axis_{name}_docs"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "Window" not in plan


def test_axes_across_batches(spark):
    """Trees of many batches, of one and of a few nodes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([r for r in forests() if r[0] is not None], "doc_id long, forest string")
        for name, n in (("sister_of", None), ("left_sister_of", None), ("immediately_precedes", None), ("ancestor_of_ith_leaf", 2), ("ancestor_of_ith_leaf", -1), ("child_of", None), ("dominates", None)):
            nodes = axes.nodes_of(df, name)
            got = axes.axis(nodes, name, n, placed=True)
            plain = trees.shred(df).withColumn("n_kids", F.lit(0)).persist()
            want = axes.pairs(plain, axes.numbered(name, n) if n else axes.SIMPLE[name][1])
            assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0, name
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
