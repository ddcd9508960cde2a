import pytest
from lexforest.operators import measures
from lexforest.operators.files import unique_stems


def test_registry_checks():
    r = measures.Registry([{"name": "A", "value_source": "VP1 + 2 * C/S".replace("C/S", "MLS")}])
    assert r.default[-1] == "A" and len(measures.Registry().default) == 23
    assert r.needed(["VP"]) == ("VP1", "VP2")
    assert r.is_sum("CN") == ["CN1", "CN2", "CN3"] and r.is_sum("MLS") is None
    with pytest.raises(measures.CircularDefinitionError):
        measures.Registry([{"name": "A", "value_source": "B + 1"}, {"name": "B", "value_source": "A"}]).needed(["A"])
    for bad in ("__import__('os')", "VP1 ** 2", "VP1 if 1 else 2", "'x'", "VP1 +"):
        with pytest.raises(measures.InvalidSourceError):
            measures.parse(bad)
    for bad in ([{"name": "A", "value_source": ""}], [{"name": "A", "value_source": "W"}] * 2, [{"name": "A"}], [{"name": "A", "tregex_pattern": "NP"}]):
        with pytest.raises(ValueError):
            measures.Registry(bad)
    with pytest.raises(ValueError):
        r.needed(["nothing"])


def test_division_by_zero(spark):
    df = spark.createDataFrame([(1, 4, 0), (2, 4, 2)], "doc_id long, W long, S long")
    got = {r.doc_id: r.MLS for r in measures.select(df, measures.Registry(), ["MLS", "MLS"]).collect()}
    assert got == {1: 0.0, 2: 2.0}


def test_unique_stems():
    assert unique_stems(["a", "a", "b", "a (2)", "a"]) == ["a", "a (2)", "b", "a (2) (2)", "a (3)"]
