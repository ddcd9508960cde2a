"""Chains of neighbours: many small trees at once and large trees as bits give the same, and rounds are few."""

import random

import numpy as np
import pytest
from lexforest.operators import axes, trees
from pyspark.sql import functions as F


def forests(draw):
    def grown(depth):
        return f"({draw.choice(['NP', 'VP', 'X', 'S'])} {' '.join(grown(depth - 1) if depth and draw.random() < 0.7 else 'w' for _ in range(draw.randint(1, 4)))})"

    return [(i, "\n".join(grown(4) for _ in range(draw.randint(0, 4)))) for i in range(60)] + [(100, "(S " + " ".join(["(NP w)"] * 40) + ")")]


def related(nodes):
    return sorted(map(tuple, axes.neighbour_chains(nodes, "x.label IN ('NP', 'VP', 'S')", placed=True).collect()))


@pytest.mark.parametrize("batch", ["10000", "13"])
def test_lists_and_bits_agree(spark, monkeypatch, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(forests(random.Random(2)), "doc_id long, forest string")
        nodes = axes.nodes_of(df, "unbroken_precedes")
        found = []
        for most in (512, 12, 0):
            monkeypatch.setattr(axes, "POSITIONS", most)
            found.append(related(nodes))
        assert found[0] == found[1] == found[2] and len(found[0]) > 5000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = trees.shred(df).where(F.col("doc_id") == 100).select("st", "left_edge", "right_edge", "label").collect()
    reach = {(a, b) for a in range(41) for b in range(a, 41)} | {(0, 40)}
    want = {(x.st, y.st) for x in plain for y in plain if (x.right_edge, y.left_edge) in reach}
    assert {(a, b) for d, _, a, b in found[0] if d == 100} == want


def test_positions_of_many_trees():
    draw = np.random.default_rng(4)
    for _ in range(50):
        size = int(draw.integers(1, 30))
        first = draw.integers(0, size, 20)
        after = np.minimum(first + draw.integers(1, 6, 20), size)
        bounds, position = axes.reached(first, after, size)
        want = axes.reachable(first, after, size)
        assert [sum(1 << int(q - p) for q in position[bounds[p] : bounds[p + 1]]) for p in range(size + 1)] == want
