"""Annotations by processor: only what is missing is computed, and state changes at once or not at all."""

import pytest
from lexforest.operators.annotations import WORDS, AnnotationStore, ConcurrentRunError, Processor
from pyspark.sql import functions as F

COUNT = Processor("n", "1", lambda: F.size("lemmas"), "int", ("lemmas",))
LONGEST = Processor("longest", "1", lambda: F.array_max(F.transform("lemmas", F.length)), "int", ("lemmas",))


def df(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows(found):
    return sorted((tuple(r) for r in found.collect()), key=lambda r: [(x is None, x) for x in r])


def test_only_missing_columns_are_computed(spark, tmp_path):
    docs = df(spark, (1, "the dog"), (2, None), (2, "two rows"), (3, "same"), (3, "same"), (None, "no name"))
    store = AnnotationStore(spark, f"{tmp_path}/store", [WORDS, COUNT])
    want = [(1, "the dog", 2), (2, "two rows", 2), (2, None, 0), (3, "same", 1), (3, "same", 1), (None, "no name", 2)]
    assert rows(store.annotate(docs, ["n"])) == want
    assert store.update(docs, ["n"]) == {"lemmas": 0, "n": 0} and store.manifest()[0] == 1
    # another processor: its column only
    store = AnnotationStore(spark, f"{tmp_path}/store", [WORDS, COUNT, LONGEST])
    assert store.update(docs, ["n", "longest"]) == {"lemmas": 0, "n": 0, "longest": 4}
    # a changed text and a new document: those only
    more = df(spark, (1, "the old dog"), (2, None), (4, "new"))
    assert store.update(more, ["longest"]) == {"lemmas": 2, "longest": 2}
    # a new version: it and what needs it
    changed = Processor("lemmas", "2", lambda: F.split("text", " "), "array<string>")
    store = AnnotationStore(spark, f"{tmp_path}/store", [changed, COUNT, LONGEST])
    assert store.update(more, ["n"]) == {"lemmas": 3, "n": 3}
    store.compact()
    assert rows(store.annotate(more, ["n"])) == [(1, "the old dog", 3), (2, None, None), (4, "new", 1)]
    assert len(list((tmp_path / "store/batches").iterdir())) == 2
    assert rows(store.annotate(df(spark), ["n"])) == []


def test_a_crash_before_the_swap_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = AnnotationStore(spark, f"{tmp_path}/store", [WORDS, COUNT])
    store.update(df(spark, (1, "a b")), ["n"])
    before = store.manifest(), rows(store.entries("n"))

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(AnnotationStore, "_swap", crash)
        store.update(df(spark, (2, "c")), ["n"])
    again = AnnotationStore(spark, f"{tmp_path}/store", [WORDS, COUNT])
    assert (again.manifest(), rows(again.entries("n"))) == before
    assert again.update(df(spark, (2, "c")), ["n"]) == {"lemmas": 1, "n": 1}
    with pytest.raises(ConcurrentRunError):
        again._swap(again.manifest()[0], {})


def test_circles_and_unknown_names(spark, tmp_path):
    a, b = (Processor(x, "1", lambda: F.lit(1), "int", (y,)) for x, y in (("a", "b"), ("b", "a")))
    with pytest.raises(ValueError, match="need each other"):
        AnnotationStore(spark, str(tmp_path), [a, b])
    with pytest.raises(ValueError, match="no processor"):
        AnnotationStore(spark, str(tmp_path), [WORDS]).annotate(df(spark, (1, "x")), ["y"])


def test_only_what_is_asked_of_a_value_is_joined(spark, tmp_path):
    docs = df(spark, (1, "the dog"), (2, None), (2, "two rows"), (None, "no name"))
    store = AnnotationStore(spark, f"{tmp_path}/store", [WORDS, COUNT])
    store.update(docs, ["lemmas", "n"])
    # nothing is missing: nothing is computed, so that no text is moved for it
    def never():
        raise AssertionError

    idle = AnnotationStore(spark, f"{tmp_path}/store", [Processor("lemmas", "1", never, "array<string>")])
    assert idle.update(docs, ["lemmas"]) == {"lemmas": 0}
    out = store.annotate(docs, ["lemmas", "n"], of={"lemmas": F.size})
    assert rows(out) == [(1, "the dog", 2, 2), (2, "two rows", 2, 2), (2, None, 0, 0), (None, "no name", 2, 2)]
    plan = out.select("doc_id", "lemmas")._jdf.queryExecution().optimizedPlan().toString()
    # sizes are taken below the join
    assert plan.index("Join") < plan.index("size(value")
