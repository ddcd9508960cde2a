"""Tokens of raw text and a rule annotator.

The annotator is a stand-in for a statistical tagger, which is not available
offline: closed classes and suffixes give a Penn tag, and the Penn tag gives a
universal one. It is a pure column expression, so it runs where the text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"

# Closed classes and suffixes of the rule annotator, first match wins.
CLOSED = (
    ("DT", ("the", "a", "an", "le", "la", "les", "un", "une", "el", "los", "der", "die", "das")),
    ("CC", ("and", "or", "but", "et", "ou", "y", "und", "oder")),
    ("TO", ("to", "zu")),
    ("WDT", ("that", "which", "que", "qui", "dass")),
    ("MD", ("can", "will", "would", "may")),
    ("VBZ", ("is", "are", "was", "were", "est", "es", "ist")),
    ("VB", ("be", "have", "do")),
    ("PRP", ("it", "he", "she", "they", "il", "elle", "er")),
    ("IN", ("of", "in", "for", "with", "by", "from", "on", "at", "as", "de", "du", "des", "par", "en", "con", "von", "mit")),
)
SUFFIXES = (("VBG", ("ing",)), ("VBD", ("ed",)), ("RB", ("ly", "ment", "mente")), ("JJ", ("ble", "ous", "al", "eux", "oso", "ig", "lich")), ("NNS", ("s",)))
UNIVERSAL = {"NOUN": ("NN", "NNS"), "VERB": ("VB", "VBD", "VBG", "VBZ"), "ADJ": ("JJ",), "ADV": ("RB",), "NUM": ("CD",), "DET": ("DT", "WDT"), "ADP": ("IN",), "CCONJ": ("CC",), "AUX": ("MD",), "PRON": ("PRP",), "PART": ("TO",)}


def penn_tag_sql(word: str) -> str:
    """CASE over a lower-case word; plain SQL."""
    quote = lambda xs: ", ".join(f"'{x}'" for x in xs)
    rows = [f"WHEN {word} IN ({quote(ws)}) THEN '{tag}'" for tag, ws in CLOSED]
    rows.append(f"WHEN substring({word}, 1, 1) BETWEEN '0' AND '9' THEN 'CD'")
    for tag, ends in SUFFIXES:
        rows.append("WHEN length({0}) > 3 AND ({1}) THEN '{2}'".format(word, " OR ".join(f"{word} LIKE '%{e}'" for e in ends), tag))
    return f"CASE {' '.join(rows)} ELSE 'NN' END"


def penn_tag_in_place(word: str) -> str:
    """What penn_tag_sql gives of a word that is not null, for Spark where words are elements of arrays: there each test is
    made by itself, so one look into the set of the closed classes spares most words all of theirs."""
    quote = lambda xs: ", ".join(f"'{x}'" for x in xs)
    closed = " ".join(f"WHEN {word} IN ({quote(ws)}) THEN '{tag}'" for tag, ws in CLOSED)
    ends = " ".join("WHEN {} THEN '{}'".format(" OR ".join(f"endswith({word}, '{e}')" for e in es), tag) for tag, es in SUFFIXES)
    known = quote(w for _, ws in CLOSED for w in ws)
    return f"CASE WHEN {word} IN ({known}) THEN CASE {closed} END WHEN substring({word}, 1, 1) BETWEEN '0' AND '9' THEN 'CD' WHEN length({word}) > 3 THEN CASE {ends} ELSE 'NN' END ELSE 'NN' END"


def universal_tag_sql(penn: str) -> str:
    rows = [f"WHEN {penn} IN ({', '.join(repr(t) for t in tags)}) THEN '{u}'" for u, tags in UNIVERSAL.items()]
    return f"CASE {' '.join(rows)} ELSE 'X' END"


def words(text: Column) -> Column:
    """Lower-case words of a text, an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def lemmas(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0) and lemma of every word."""
    return docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "lemma"))


def with_tags(rows: DataFrame, tagset: str = "ud") -> DataFrame:
    """rows with the tag of their lemma."""
    penn = F.expr(penn_tag_sql("lemma"))
    if tagset == "ptb":
        return rows.withColumn("tag", penn)
    # a map, so that the long expression stands in the plan once
    names = F.create_map(*(F.lit(x) for u, tags in UNIVERSAL.items() for t in tags for x in (t, u)))
    return rows.withColumn("tag", F.coalesce(F.try_element_at(names, penn), F.lit("X")))


def tokens(docs: DataFrame, tagset: str = "ud") -> DataFrame:
    """doc_id, pos (from 0), lemma and tag of every word."""
    return with_tags(lemmas(docs), tagset)


def vocabulary(per_lemma: DataFrame, tagset: str = "ud") -> DataFrame:
    """lemma, freq, ins_ord and tag of the distinct words in rows of lemma and n.

    The long tag expression runs once a word, not once a token. Several parts of a
    query read the vocabulary, so it is kept (on disk where memory is short).
    """
    return with_tags(per_lemma.groupBy("lemma").agg(F.sum("n").alias("freq")), tagset).withColumn("ins_ord", F.col("lemma")).persist()
