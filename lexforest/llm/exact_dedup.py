"""Operator 13: exact deduplication that takes frequent texts apart from the rest.

Two texts are equal if their UTF-8 bytes are equal once A to Z are in lower case;
the SHA-256 of those bytes stands for the text. Each text is read once, for its
digest, and the narrow table of digests is written.

A Misra-Gries summary of every partition of that table (``COUNTERS`` counters, whatever
its size) names all digests that can be frequent: one that has more than the
share 1 / (COUNTERS + 1) of all rows has it of some partition too. Of the names, the
COUNTERS that count most are counted exactly, by a partial aggregate, and those that do
have that share are the winners: at most COUNTERS rows of (digest, row
that stays, size), a table of a known bound, which is broadcast. Rows of a winner
learn their group on the map side; they are never shuffled, however many they are.
All other digests have a bounded share of the rows and are shuffled once, by digest.

Edge cases: null counts as the empty text, which is a text; a null doc_id is below
all others, so it stays only in a group without another; of rows that share doc_id
and text one stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counters of a summary, and the most rows that are broadcast.
COUNTERS = 1024


def digest(text: Column) -> Column:
    """SHA-256 of a text in lower case (A to Z only), as bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), 256))


class MisraGries:
    """At most so many counters; an item's counter is too low by n / (counters + 1) at most, after n items."""

    def __init__(self, counters: int):
        self.counters = counters
        self.of: Counter = Counter()

    def add(self, counts: Counter) -> None:
        self.of.update(counts)
        if len(self.of) > self.counters:
            cut = sorted(self.of.values(), reverse=True)[self.counters]
            self.of = Counter({x: n - cut for x, n in self.of.items() if n > cut})


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest of at most so many digests, all those with more than 2 / (counters + 1) of the rows among them."""

    def summarise(batches):
        import pyarrow as pa

        summary = MisraGries(counters)
        for batch in batches:
            found = batch.column(0).value_counts()
            summary.add(Counter(dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True))))
        yield pa.RecordBatch.from_arrays([pa.array(list(summary.of), pa.binary()), pa.array(list(summary.of.values()), pa.int64())], names=["digest", "n"])

    each = digests.select("digest").mapInArrow(summarise, "digest binary, n long")
    return each.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of every row."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    # the number of a row only tells rows of one doc_id and text apart; it is written, so that it is the same at each reading
    rows = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")).withColumn("at", F.monotonically_increasing_id()))
    n = rows.count()
    best = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "at")
    named = scratch.save(frequent(rows, counters))
    # named has at most so many rows as there are counters
    exact = rows.join(F.broadcast(named), "digest").groupBy("digest").agg(F.max(best).alias("best"), F.count("*").alias("group_size"))
    winners = scratch.save(exact.where(F.col("group_size") * (counters + 1) > n).withColumn("winner", F.lit(True)))
    told = rows.join(F.broadcast(winners), "digest", "left")
    # the others are shuffled once
    group = Window.partitionBy("digest")
    rest = told.where("winner IS NULL").withColumns({"best": F.max(best).over(group), "group_size": F.count("*").over(group)})
    out = told.where("winner").unionByName(rest)
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("best.at")).alias("kept"), "digest")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
