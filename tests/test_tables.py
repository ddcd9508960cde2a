"""Groups and tables as users handle them."""

import json

from lexforest import sinks
from lexforest.operators import combine, tables
from pyspark.sql import functions as F


def test_groups_are_split_and_merged(spark):
    groups = spark.createDataFrame([("g", [3, 1, 2]), ("h", [5, 4])], "group_id string, members array<long>")
    rows = combine.split_groups(groups)
    assert sorted((r.group_id, r.ord, r.doc_id) for r in rows.collect()) == [("g", 0, 3), ("g", 1, 1), ("g", 2, 2), ("h", 0, 5), ("h", 1, 4)]
    assert sorted(map(tuple, combine.merge_groups(rows).collect())) == [("g", [3, 1, 2]), ("h", [5, 4])]
    assert [r.doc_id for r in tables.subfiles(rows, "g").collect()] == [3, 1, 2]
    names = spark.createDataFrame([(i, f"f{i}") for i in range(1, 6)], "doc_id long, name string")
    assert sorted(map(tuple, combine.combined_name(rows, names).collect())) == [("g", "f3+f1+f2"), ("h", "f5+f4")]


def test_matches_of_groups_stand_in_the_order_of_members(spark):
    m = spark.createDataFrame([(1, "VP", 0, "a"), (1, "VP", 1, "b"), (2, "VP", 0, "c"), (1, "S", 0, "s")], "doc_id long, measure string, ord int, match string")
    groups = spark.createDataFrame([(2, "g", 0), (1, "g", 1)], "doc_id long, group_id string, ord int")
    got = sorted((r.measure, r.ord, r.match) for r in combine.combine_matches(m, groups).collect())
    assert got == [("S", 0, "s"), ("VP", 0, "c"), ("VP", 1, "a"), ("VP", 2, "b")]


def test_rows_are_removed_and_made_long(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, None), (3, 0.5, 4)], "doc_id long, MLS double, W long")
    assert {r.doc_id for r in tables.remove_rows(df, spark.createDataFrame([(1,)], "doc_id long")).collect()} == {2, 3}
    assert {r.doc_id for r in tables.drop_empty(df).collect()} == {1, 3}
    assert {(r.doc_id, r.measure, r.value) for r in tables.long_values(df).where("value IS NOT NULL").collect()} == {(1, "MLS", 2.0), (3, "MLS", 0.5), (3, "W", 4.0)}
    assert [(r.row, r.doc_id) for r in tables.sorted_rows(df, [F.desc("doc_id")], 2).collect()] == [(1, 3), (2, 2)]


def test_json_is_one_array(spark, tmp_path):
    for n in (0, 1, 3):
        sinks.write_one(spark.range(n).selectExpr("id", "'é' AS t"), str(tmp_path / "x.json"), "json")
        want = [{"id": str(i), "t": "é"} for i in range(n)]
        assert (tmp_path / "x.json").read_text(encoding="utf-8") == json.dumps(want, ensure_ascii=False, indent=2) + "\n"
