"""Words of documents are counted where their text lies: they are not shuffled by word, by class or by section."""

import re

import __spark_entry__ as entry
import duckdb
import pytest
from lexforest import queries
from lexforest.operators import lexical

SMALL = "/root/testdata/sf0.001"


def by_duckdb(name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    return [x[0] for x in found.description], sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["lca_types_all", "lca_types_list", "lca_counts", "lca_combine", "section_types", "lca_classes"])
def test_same_as_sql(spark, name):
    names, want = by_duckdb(name)
    assert sorted(map(tuple, entry.queries()[name](spark, SMALL).select(*names).collect()), key=repr) == want


@pytest.mark.parametrize("name", ["lca_types_all", "lca_types_list", "lca_counts", "section_types", "lca_ndw", "lca_variation", "lca_density", "lca_log_family"])
def test_words_stay_with_their_document(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    # what lies inside of kept vocabularies is apart from the words of documents
    plan = "\n".join(x for x in plan.splitlines() if "InMemoryRelation" not in x)
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id", plan)) == 1
    assert "SortMergeJoin" not in plan.split("InMemoryTableScan")[0]


def test_many_adverbs_are_joined_by_shuffle(spark, monkeypatch):
    want = sorted(map(tuple, queries.lca_counts(spark, SMALL).collect()))
    monkeypatch.setattr(lexical, "BROADCAST", -1)
    assert sorted(map(tuple, queries.lca_counts(spark, SMALL).collect())) == want
