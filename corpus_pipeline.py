"""A training-data pipeline over ``documents`` in five stages, each calling one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents; n_chars follows the text. Null and empty texts pass every
stage but the mix, which has no words to take from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforest.llm.common import WORD, Scratch, numbered, table
from lexforest.llm.line_dedup import line_dedup
from lexforest.llm.mixing import mix
from lexforest.llm.near_dup import near_duplicates
from lexforest.llm.packing import pack
from lexforest.llm.quality import fit, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Five-word shingles, similarity 0.8 or more.
SHINGLE, SIMILARITY = 5, (80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    docs = docs.select(*COLUMNS)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand earlier in the corpus; a document of such lines only has an empty text."""
    docs = numbered(Scratch(spark, "pipeline"), docs.select(*COLUMNS))
    found = line_dedup(docs).where(F.size("dropped") > 0).select("__row", "dropped")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("dropped", i)), "\n")
    out = docs.join(found, "__row", "left")
    changed = F.col("dropped").isNotNull()
    out = out.withColumn("text", F.when(changed, kept).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; of repeated rows the first."""
    docs = numbered(Scratch(spark, "pipeline"), docs.select(*COLUMNS))
    found = near_duplicates(docs, SHINGLE, SIMILARITY)
    firsts = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("__row").alias("__row")).select("__row")
    rows = firsts.union(found.where("doc_id IS NULL").select("__row"))
    return docs.join(rows, "__row", "left_semi").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that the budget cuts keeps the words taken."""
    docs = numbered(Scratch(spark, "pipeline"), docs.select(*COLUMNS))
    _, schedule = mix(docs, row="__row")
    taken = docs.join(schedule.select(F.col("row_id").alias("__row"), "words", "whole"), "__row")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    taken = taken.withColumn("text", F.when(F.col("whole"), F.col("text")).otherwise(cut))
    return taken.withColumn("n_chars", F.when(F.col("whole"), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicate", near_duplicate), ("mixing", mixing), ("packing", packing)]

#: The classifier, the sketches and the tokenizer are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        if name != STAGES[0][0]:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
