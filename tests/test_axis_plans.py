"""Axis queries cut the forests once and leave the nodes by document: no node table is joined with itself."""

import re

import __spark_entry__ as entry
import pytest
from lexforest import shared

SMALL = "/root/testdata/sf0.001"
NAMES = ("child_of", "equals", "dominates", "dominated_by", "headed_by", "immediately_heads", "immediate_left_sister_of", "sister_of", "immediately_follows", "ancestor_of_ith_leaf_2", "ancestor_of_ith_leaf_last", "ith_child_of_last", "unbroken_precedes")


@pytest.mark.parametrize("name", NAMES)
def test_nodes_are_shuffled_once(spark, name):
    plan = entry.queries()[f"axis_{name}_docs"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "SortMergeJoin" not in plan


def test_parts_grow_with_the_files(spark, monkeypatch):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(shared, "PIECE", 1 << 10)
    size = sum(shared.file_system(spark, p)[0].getFileStatus(shared.file_system(spark, p)[1]).getLen() for p in rows.inputFiles())
    assert shared.dealt(rows).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-size // 1024))
