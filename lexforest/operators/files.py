"""Sets of input files and the annotation cache, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIXES = ("txt", "docx", "odt")


def suffix(path):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def add_files(asked: DataFrame, have: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """path and status (added, already added, unsupported or empty) of each distinct asked path (path, size)."""
    one = asked.groupBy("path").agg(F.max("size").alias("size")).join(have.select("path").distinct().withColumn("old", F.lit(True)), "path", "left")
    status = F.when(F.col("old").isNotNull(), "already added")
    if suffixes is not None:
        status = status.when(~suffix(F.col("path")).isin(*suffixes), "unsupported")
    return one.select("path", status.when(F.coalesce("size", F.lit(0)) == 0, "empty").otherwise("added").alias("status"))


def cache_lookup(source: DataFrame, cached: DataFrame) -> DataFrame:
    """source (path, mtime) with valid: an annotation (path, cached_at, size) is there, strictly newer and not empty."""
    both = source.join(cached, "path", "left")
    return both.withColumn("valid", F.coalesce((F.col("cached_at") > F.col("mtime")) & (F.col("size") > 0), F.lit(False)))


def missing_annotations(documents: DataFrame, annotated: DataFrame, *by: str) -> DataFrame:
    """Documents whose annotation is not there yet; by: what tells them apart, else their doc_id."""
    on = list(by or ("doc_id",))
    return documents.join(annotated.select(*on), on, "left_anti")


def keep_sentences(sentences: DataFrame) -> DataFrame:
    """Annotated sentences (words: array of struct with upos) without those of a single mark."""
    return sentences.where(~((F.size("words") == 1) & (F.element_at("words", 1)["upos"] == "PUNCT")))


def unique_stems(stems: list[str]) -> list[str]:
    """Each stem with the first free number after it, as file dialogs do; a few names on the driver."""
    taken: set[str] = set()
    out = []
    for stem in stems:
        name, n = stem, 2
        while name in taken:
            name, n = f"{stem} ({n})", n + 1
        taken.add(name)
        out.append(name)
    return out
