"""Keys that many lines share: no near line is lost, and no pairs come of lines that are not near."""

import random

from pyspark.sql import functions as F

from lexforest.llm import line_dedup
from lexforest.llm.common import Scratch, numbered


def dropped(spark, lines):
    docs = spark.createDataFrame([(i, "\n".join(lines[i::20])) for i in range(20)], "doc_id long, text string")
    return sum(len(r.dropped) for r in line_dedup.line_dedup(numbered(Scratch(spark, "test"), docs)).collect())


def test_edits_move_the_place_between_two_segments(spark, monkeypatch):
    """An insertion in the first segment and a replacement in the second: the rest of both segments differs by these two only."""
    monkeypatch.setattr(line_dedup, "FEW", 4)
    monkeypatch.setattr(line_dedup, "PER_KEY", 0.005)
    rng = random.Random(3)
    middle = ["".join(rng.choice("0123456789") for _ in range(16)) for _ in range(60)]
    frame = "record no. {} " + "was made by the office and kept here"
    lines = [frame.format(m) for m in middle]
    assert {len(x) for x in lines} == {64}
    near = [frame.format(m[0] + "x" + m[1:13] + "y" + m[14:]) for m in middle[:20]]
    assert dropped(spark, lines + near) == 20


def test_lines_of_a_key_that_are_not_near_give_no_pairs(spark, monkeypatch):
    """A hundred lines with one start and one end, and the same characters between in other orders."""
    made, mark = [], line_dedup.EditJoin._mark
    monkeypatch.setattr(line_dedup.EditJoin, "_mark", lambda self, pairs: (made.append(pairs.count()), mark(self, pairs)))
    rng = random.Random(5)
    lines = ["this is how each of the lines " + "".join(rng.sample("abcdefghijklmnopqrstuvwxyzABCD", 30)) + " and so they come to an end ..." for _ in range(100)]
    near = [x.replace("each", "eech") for x in lines[50:60]]
    assert dropped(spark, lines + near) == 10
    assert sum(made) < 2000


def test_rests_within_two_edits_together(spark):
    """Against the distances themselves; rests may be empty, and edits may stand at either end or beside each other."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))

    def edited(x, n):
        x = list(x)
        for _ in range(n):
            at, kind = rng.randrange(len(x) + 1), rng.randrange(3)
            x[at : at + (kind != 0)] = [rng.choice("abé")] if kind < 2 else []
        return "".join(x)

    rows = []
    for _ in range(1500):
        a, b = word(rng.randrange(9)), word(rng.choice([0, 3, 40]))
        rows.append((a, b, edited(a, rng.randrange(3)), edited(b, rng.randrange(4))))
    near = line_dedup.both_within((F.col("a"), F.col("b")), (F.col("c"), F.col("d")), 2)
    got = spark.createDataFrame(rows, "a string, b string, c string, d string").select("*", near.alias("near"), (F.levenshtein("a", "c") + F.levenshtein("b", "d") <= 2).alias("want")).collect()
    assert [r for r in got if r.near != r.want] == [] and 200 < sum(r.want for r in got) < 1300
