"""Result tables as users handle them: sorting, selecting, removing, exporting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sorted_rows(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows in an order, numbered from 1. The limit is what makes numbering cheap."""
    first = df.orderBy(*order).limit(limit)
    return first.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("row"), *df.columns)


def remove_rows(df: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(chosen.select(key), key, "left_anti")


def drop_empty(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.na.drop("all", subset=[c for c in df.columns if c != key])


def subfiles(groups: DataFrame, group_id: str) -> DataFrame:
    return groups.where(F.col("group_id") == group_id).orderBy("ord")


def long_matches(matches: DataFrame) -> DataFrame:
    """Filename, Structure, Match."""
    return matches.select(F.col("doc_id").cast("string").alias("Filename"), F.col("measure").alias("Structure"), F.col("match").alias("Match"))


def long_values(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, measure and value of every measure of a wide result."""
    names = [c for c in df.columns if c != key]
    cells = F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names))
    return df.select(key, F.explode(cells).alias("c")).select(key, "c.measure", "c.value")
