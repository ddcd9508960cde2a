"""Documents combined to groups: counts add up, types are counted anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_groups(groups: DataFrame) -> DataFrame:
    """group_id and error of groups of one member, which are refused."""
    return groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n = 1").select("group_id", F.lit("a group needs two members or more").alias("error"))


def combine_counts(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id and the summed primitive counts of (doc_id, counts...); groups: doc_id, group_id, ord."""
    names = [c for c in counted.columns if c != "doc_id"]
    return counted.join(groups, "doc_id").groupBy("group_id").agg(*(F.sum(c).alias(c) for c in names))


def combine_matches(matches: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, measure, ord and match: the members' matches (doc_id, measure, ord, match) one after another, by member.

    A match moves on by the number of matches of the members before it, so no group is gathered.
    """
    sizes = matches.groupBy("doc_id", "measure").agg(F.count("*").alias("n")).join(groups.withColumnRenamed("ord", "member"), "doc_id")
    earlier = Window.partitionBy("group_id", "measure").orderBy("member", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("doc_id", "group_id", "measure", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return matches.join(sizes, ["doc_id", "measure"]).select("group_id", "measure", (F.col("ord") + F.col("before")).cast("long").alias("ord"), "match")


def combine_tokens(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """Tokens with the group for doc_id and the member's ord; place is (ord, pos)."""
    return tokens.join(groups, "doc_id").drop("doc_id").withColumnRenamed("group_id", "doc_id")


def combined_name(groups: DataFrame, names: DataFrame) -> DataFrame:
    """group_id and the members' names joined by +."""
    both = groups.join(names, "doc_id")
    return both.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), "+").alias("name"))


def split_groups(members: DataFrame) -> DataFrame:
    """doc_id, group_id, ord from (group_id, members: array of doc_id)."""
    return members.select("group_id", F.posexplode("members").alias("ord", "doc_id"))


def merge_groups(groups: DataFrame) -> DataFrame:
    """group_id and members, an array of doc_id by ord."""
    return groups.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "doc_id"))), lambda x: x["doc_id"]).alias("members"))
