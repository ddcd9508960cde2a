"""Bracketed forests built from raw sentences by the rule annotator.

No parser is available offline. A forest of shallow phrases (noun, prepositional
and verb phrases and relative clauses) is written by pattern replacement, so that
tree operators can run over a whole corpus. It says nothing about grammar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import dealt
from .tokens import WORD, penn_tag_in_place

# Phrase patterns and their replacements, applied in order. {n} is a group.
# Repeats are bounded, since the regular expressions of the JVM recurse once a repeat.
CHUNKS = (
    (r"((\((DT|JJ|CD|NN|NNS|PRP) [^() ]+\) ?){1,40})", "(NP {1}) "),
    (r"\(NP ((\([A-Z]+ [^() ]+\) ?){1,40})\) \(CC ([^() ]+)\) \(NP ((\([A-Z]+ [^() ]+\) ?){1,40})\)", "(NP (NP {1}) (CC {3}) (NP {4}))"),
    (r"\(IN ([^() ]+)\) \(NP ((\([A-Z]+ [^() ]+\) ?){1,40})\)", "(PP (IN {1}) (NP {2}))"),
    (r"\((MD|VBZ|VBD|VBG|VB) ([^() ]+)\)( \(NP (\([A-Z]+ [^() ]+\) ?){1,40}\))?", "(VP ({1} {2}){3})"),
    (r"\(VP (\(VBG [^() ]+\)( \(NP (\([A-Z]+ [^() ]+\) ?){1,40}\))?)\) {1,2}\(VP ", "(S (VP {1})) (VP "),
    (r"^ ?\(VP \((MD|VBZ) ([^() ]+)\)( \(NP (\([A-Z]+ [^() ]+\) ?){1,40}\))?\)(.*)$", "(SQ ({1} {2}){3}{5})"),
    (r"\(WDT ([^() ]+)\) (.*)$", "(SBAR (WHNP (WDT {1})) (S {2}))"),
    (r"\(VP (\((MD|VBZ|VBD|VBG|VB) [^() ]+\))\) {1,2}\(SBAR (.*)\)$", "(VP {1} (SBAR {3}))"),
)
#: What a sentence of phrases stands under: a question, a clause or a fragment.
SENTENCE = "CASE WHEN t LIKE '(SQ %' THEN concat('(ROOT ', t, ')') WHEN t LIKE '%(VP %' THEN concat('(ROOT (S ', t, ' (. .)))') ELSE concat('(ROOT (FRAG ', t, ' (. .)))') END"


def chunked_sql(tagged: str, group: str, flags: str = "") -> str:
    """Nested replacements over a string of tagged words; group is how a dialect writes a group."""
    for pattern, target in CHUNKS:
        for n in "12345":
            target = target.replace("{%s}" % n, group + n)
        tagged = f"regexp_replace({tagged}, '{pattern}', '{target}'{flags})"
    return tagged


def surrogate_forests(docs: DataFrame) -> DataFrame:
    """doc_id and forest, a tree a sentence; one expression a document, nothing is exploded."""
    words = F.filter(F.transform(F.split(F.lower("text"), r"[.!?\n]+"), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0))), lambda ws: F.size(ws) > 0)
    escape = lambda sql: sql.replace("\\", "\\\\")
    tagged = f"array_join(transform(ws, w -> concat('(', {penn_tag_in_place('w')}, ' ', w, ')')), ' ')"
    trees = f"transform(transform(sentences, ws -> {escape(chunked_sql(tagged, '$'))}), t -> {SENTENCE})"
    docs = dealt(docs.select("doc_id", "text"))  # the node table keeps this partitioning
    return docs.select("doc_id", words.alias("sentences")).select("doc_id", F.expr(f"array_join({trees}, '\\n')").alias("forest"))
