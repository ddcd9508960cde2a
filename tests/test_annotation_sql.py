"""The store's query is its SQL on repeated and missing keys and texts."""

import __spark_entry__ as entry
import duckdb


def test_annotation_store_is_its_sql(spark, tmp_path):
    rows = [(1, "The cats run."), (1, "A dog barked"), (1, "The cats run."), (2, None), (3, ""), (None, "some words here"), (None, None), (4, "Kings and queens"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {tuple(r) for r in con.execute(entry.oracle_sql()["annotation_store"]).fetchall()}
    got = [tuple(r) for r in entry.queries()["annotation_store"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) == 5 and set(got) == want
