"""Quicker forms of the tag expression and of the pattern of counted words give what the plain ones give."""

import random
import re

import __spark_entry__ as entry
from lexforest.operators import patterns, tokens
from pyspark.sql import functions as F


def test_counted_words_are_those_of_the_plain_pattern(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choice(["(", "(A", "(AB$", " ", " ", ")", "ab", "1", "é", "—", "-", "–", "B"]) for _ in range(40)) for _ in range(2000)] + ["(NN )", "(NN a)", "(PRP$ dog) (NN Été) (. .)", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, forest string")
    want = {i: len(re.findall(patterns.WORD, t or "")) for i, t in enumerate(texts)}
    assert sum(want.values()) > 100
    assert {r.doc_id: r.W for r in patterns.word_counts(df).collect()} == want


def test_tags_are_those_of_the_plain_expression(spark):
    ends = [e for _, es in tokens.SUFFIXES for e in es]
    words = [w for _, ws in tokens.CLOSED for w in ws] + ends + ["x" + e for e in ends] + ["word" + e for e in ends] + ["", "1st", "a1", "été", "dog", "éing", "ééng"]
    df = spark.createDataFrame([(words,)], "ws array<string>")
    got = df.select(*(F.expr(f"transform(ws, w -> {f('w')})") for f in (tokens.penn_tag_sql, tokens.penn_tag_in_place))).first()
    assert got[0] == got[1] and len(set(got[0])) > 12


def test_the_forests_ask_one_set_first(spark):
    plan = entry.queries()["sca_W"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan
