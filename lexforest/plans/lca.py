"""Lexical complexity: tokens to counts and indices."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import combine, lexical


def analyse(tokens: DataFrame, frequencies: DataFrame, adjectives: DataFrame, tagset: str = "ud", easy: int = lexical.EASY, section: int = lexical.SECTION, trials: int = lexical.TRIALS, order=("pos",)) -> DataFrame:
    """doc_id, the eighteen counts and the twenty-five indices."""
    per = lexical.lemma_counts(tokens, "doc_id", "lemma", "tag")
    counted = lexical.counts(lexical.classify(per, lexical.easy_words(frequencies, easy), adjectives, tagset))
    kept = tokens.where(~lexical.is_misc(tokens["lemma"], tokens["tag"], tagset))
    of_sections = lexical.sampled(kept, section, trials) if order == ("pos",) else lexical.sampled_groups(kept, section, trials, order=order)
    return counted.join(lexical.indices(counted), "doc_id").join(of_sections, "doc_id")


def matches(tokens: DataFrame, frequencies: DataFrame, adjectives: DataFrame, tagset: str = "ud", easy: int = lexical.EASY) -> DataFrame:
    """doc_id, measure, ord and match: the types and tokens of every class."""
    classified = lexical.classify(tokens, lexical.easy_words(frequencies, easy), adjectives, tagset)
    return lexical.matches(classified).unionByName(lexical.token_matches(classified))


def combined(tokens: DataFrame, groups: DataFrame, frequencies: DataFrame, adjectives: DataFrame, **options) -> DataFrame:
    """The same for groups of documents, from their tokens in order."""
    joined = combine.combine_tokens(tokens, groups)
    return analyse(joined, frequencies, adjectives, order=("ord", "pos"), **options).withColumnRenamed("doc_id", "group_id")
