"""Per-document measures over a stream of documents.

The measures that stay within a row need no state, so a stream of documents is
the batch plan; running totals by source are an aggregate with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_div
from ..operators.lexical import msttr, ndw_first
from ..operators.patterns import WORD_IN_PLACE
from ..operators.surrogate import surrogate_forests
from ..operators.tokens import words


def lexical_stream(docs: DataFrame) -> DataFrame:
    """doc_id, word_t, word_n, TTR, NDW-50 and MSTTR of (doc_id, text), batch or stream."""
    w = docs.withColumn("w", words(F.col("text"))).withColumns({"word_t": F.size(F.array_distinct("w")), "word_n": F.size("w")})
    return w.select("doc_id", "word_t", "word_n", safe_div(F.col("word_t"), F.col("word_n")).alias("TTR"), ndw_first(F.col("w")).alias("NDW-50"), F.when(F.col("word_n") > 0, msttr(F.col("w"))).alias("MSTTR"))


def forest_word_stream(docs: DataFrame) -> DataFrame:
    return surrogate_forests(docs).select("doc_id", F.regexp_count("forest", F.lit(WORD_IN_PLACE)).alias("W"))


def windowed_words(docs: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Words and documents of (ts, source, text) by window and source; rows later than the watermark are left out."""
    w = docs.withWatermark("ts", late).withColumn("n", F.size(words(F.col("text"))))
    return w.groupBy(F.window("ts", width), "source").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_docs"))
