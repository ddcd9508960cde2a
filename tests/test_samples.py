"""Random samples sort the hashes below a bound only, and give what sorting all of them gives."""

import hashlib

import pytest
from lexforest.operators import lexical
from pyspark.sql import functions as F

WORDS = [f"w{i % 97}" for i in range(3000)]


def plain(key, words):
    if len(words) <= 50:
        return float(len(set(words)))
    drawn = lambda t: sorted((hashlib.md5(f"{key}|{t}|{i}".encode()).hexdigest(), w) for i, w in enumerate(words))[:50]
    return sum(len({w for _, w in drawn(t)}) for t in range(10)) / 10.0


@pytest.mark.parametrize("spare", [2.5, 0.5])
def test_samples(spark, monkeypatch, spare):
    monkeypatch.setattr(lexical, "SPARE", spare)
    rows = [(n, WORDS[:n]) for n in (1, 50, 51, 124, 126, 400, 3000)]
    got = spark.createDataFrame(rows, "k long, ws array<string>").select("k", lexical.ndw_random(F.col("k"), F.col("ws")).alias("x")).collect()
    assert {r.k: r.x for r in got} == {k: plain(k, ws) for k, ws in rows}
