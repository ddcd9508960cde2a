"""Syntactic complexity: forests to counts, measures and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import combine, measures, patterns, trees


def flagged(forests: DataFrame, partitioned: bool = False) -> DataFrame:
    """The flagged node table; columns that a caller doesn't read are not computed."""
    return patterns.flagged(trees.shred(forests, partitioned))


def counts(forests: DataFrame, names=measures.COUNTED, partitioned: bool = False) -> DataFrame:
    """doc_id and the named counted measures of every document; unbalanced ones count no structures."""
    return patterns.counts_in_place(forests, tuple(names), partitioned)


def analyse(forests: DataFrame, select=None, definitions: list[dict] | None = None, partitioned: bool = False) -> DataFrame:
    """doc_id and the selected measures (default: all 23 and the user's). Only what they need is counted."""
    registry = measures.Registry(definitions)
    names = list(dict.fromkeys(select or registry.default))
    return measures.select(counts(forests, registry.needed(names), partitioned), registry, names)


def combined(forests: DataFrame, groups: DataFrame, select=None, definitions: list[dict] | None = None, partitioned: bool = False) -> DataFrame:
    """group_id and measures of the groups of documents."""
    registry = measures.Registry(definitions)
    names = list(dict.fromkeys(select or registry.default))
    total = combine.combine_counts(counts(forests, registry.needed(names), partitioned), groups)
    return measures.select(total, registry, names, "group_id")


def matches(forests: DataFrame, names=patterns.PRIMITIVES) -> DataFrame:
    """doc_id, measure, ord and match (the words below) of every structure."""
    found = trees.spans(trees.shred(forests), patterns.matches(flagged(forests), names))
    w = Window.partitionBy("doc_id", "measure").orderBy("tree_id", "st")
    return found.select("doc_id", "measure", (F.row_number().over(w) - 1).alias("ord"), F.col("span").alias("match"))


def measure_matches(forests: DataFrame, select=None, definitions: list[dict] | None = None) -> DataFrame:
    """doc_id, measure, ord and match of the selected measures that count or only add: a sum has its parts' matches, part by part."""
    registry = measures.Registry(definitions)
    parts = [(n, i, p) for n in dict.fromkeys(select or registry.default) for i, p in enumerate(registry.is_sum(n) or []) if p in patterns.PRIMITIVES]
    if not parts:
        return forests.sparkSession.createDataFrame([], "doc_id long, measure string, ord int, match string")
    # a row a measure and part
    of = F.broadcast(forests.sparkSession.createDataFrame(parts, "name string, part int, measure string"))
    found = matches(forests, tuple(dict.fromkeys(p for _, _, p in parts))).join(of, "measure")
    w = Window.partitionBy("doc_id", "name").orderBy("part", "ord")
    return found.select("doc_id", F.col("name").alias("measure"), (F.row_number().over(w) - 1).alias("ord"), "match")
