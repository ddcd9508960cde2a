import re
from collections import Counter

import corpus_pipeline as pipeline
from lexforest.llm.common import Scratch


def test_stages(spark, docs, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 6 != 5), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    scratch, now, seen = Scratch(spark, "test"), spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES:
        before, now = now, scratch.save(stage(spark, now, str(tmp_path)))
        seen[name] = (before, now)
        if name != "packing":
            assert now.columns == pipeline.COLUMNS
    kept = {r.doc_id for r in seen["quality"][1].collect()}
    assert kept == {r.doc_id for r in docs.collect() if not (r.doc_id < 60 and r.doc_id % 6 == 5)}
    before, after = seen["lines"]
    assert Counter(r.doc_id for r in before.collect()) == Counter(r.doc_id for r in after.collect())
    assert all(r.n_chars == len(r.text or "") for r in after.collect())
    left = {r.doc_id: r.text for r in after.collect()}
    # lines that stand earlier go, however short
    assert left[101] == left[108] == "" and left[3] and left[107] == "one"
    near = [r.doc_id for r in seen["near_duplicate"][1].collect()]
    assert len(near) == len(set(near)) and {0, 1, 3, 104, 105, 107, 108} <= set(near)
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect())
    assert abs(words(seen["mixing"][1]) - 1.5 * words(seen["mixing"][0])) <= 10
    run = pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.doc_tokens) for r in run.where("start = 0").collect()) == Counter((r.doc_id, r.doc_tokens) for r in seen["packing"][1].where("start = 0").collect())


def test_empty_tables(spark, none, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
