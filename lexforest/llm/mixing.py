"""Operator 5: mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source gets a target number of words: shares by weight, none above a
multiple of its size, the excess reshared by weight (water filling). A source's
documents are shuffled by a hash and stand in a queue, once for each pass over
the source; an item's virtual finish time is the words of its queue up to its
end divided by the source's target. The items of all queues are sorted by that
time, by ranges, and taken until the total budget is spent; the item that crosses
its source's deadline (time 1) is split there, so that each source's words meet
its target.

No source is gathered in one task: its words before a document are the sums of
the hash buckets before its own (a table of a few rows a shuffle partition) and
those before it in its bucket.

Edge cases: null text has size 0 and is never taken; a null source is a source,
last in order; sources without words get target 0; repeated rows are separate
documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, numbered, shuffle_partitions, table
from .ordering import globally_sorted, ranked, running

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED = 20
#: Hash buckets a shuffle partition, over all sources.
BUCKETS = 3

KEY = ["no_source", "source_key"]


def targets(scratch: Scratch, sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds target to KEY, source_size and others. Sources are ordered by ranges, so there may be very many."""
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    s = ranked(globally_sorted(scratch, sources, KEY)).withColumn("weight", weight)
    s = s.select(*sources.columns, "weight", (F.col("source_size") * float(most) / F.col("weight")).alias("ratio"))
    s = globally_sorted(scratch, s, ["ratio", *KEY])
    sizes = running(s, "source_size").select(*KEY, F.col("__upto").alias("size_upto"), F.col("__total").alias("size"))
    s = running(s, "weight", "double").join(sizes, KEY)
    # the level if all with a smaller ratio are full and the rest share by weight
    rest = F.col("__total") - F.col("__upto") + F.col("weight")
    level = (F.col("size") * share - (F.col("size_upto") - F.col("source_size")) * float(most)) / rest
    s = s.withColumn("level", level).select(*sources.columns, "weight", "ratio", "level")
    # the first source that is not full says the level of all
    found = s.where("ratio >= level").agg(F.min_by("level", F.struct("ratio", *KEY))).first()[0]
    cap = F.col("source_size") * float(most)
    return s.withColumn("target", cap if found is None else F.least(cap, F.col("weight") * F.lit(found))).drop("weight", "ratio", "level")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, row: str = "__row") -> tuple[DataFrame, DataFrame]:
    """(documents, schedule). row: the column of docs that numbers the rows, the same at each reading (see ``numbered``), so that reruns agree.

    documents: row_id, doc_id, source, size, source_size, target.
    schedule: row_id, pass, words, whole (the item is the whole document),
    virtual_finish and mixed_before (words of the mix before the item).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    source = F.col("source").cast("string")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = scratch.save(
        docs.select(
            F.col(row).alias("row_id"),
            F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), source.isNull().cast("int").alias("no_source"), F.coalesce(source, F.lit("")).alias("source_key"), size.alias("size"),
        )
    )
    n = BUCKETS * shuffle_partitions(spark)
    sources = narrow.groupBy(*KEY).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    total, n_rows = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    sources = targets(scratch, sources, weights, share, most).withColumn("buckets", F.ceil(n * F.col("n_rows") / F.lit(max(1, n_rows)))).drop("n_rows")
    sources = scratch.save(sources.withColumn("quota", F.round("target").cast("long")))
    # place in the shuffled queue: 53 bits of a hash, as a fraction
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("row_id")), 11) * F.lit(2.0**-53)
    # sources is small or large as the data have it: Spark broadcasts it only under its own size limit
    d = narrow.join(sources, KEY).withColumn("place", place).withColumn("bucket", F.floor(F.col("place") * F.col("buckets")))
    own = Window.partitionBy(*KEY, "bucket").orderBy("place", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*KEY, "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*KEY, "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("bucket_before"))
    d = d.join(sums, [*KEY, "bucket"]).withColumn("before", F.col("bucket_before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    items = d.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("start", F.col("before") + F.col("pass") * F.col("source_size"))
    items = items.withColumn("words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("start")))).where("words > 0")
    items = items.select("row_id", "pass", "words", (F.col("words") == F.col("size")).alias("whole"), ((F.col("start") + F.col("words")) / F.col("target")).alias("virtual_finish"))
    ordered = globally_sorted(scratch, items, ["virtual_finish", "row_id", "pass"])
    budget = round(min(total * share, total * float(most)))
    # quotas are rounded, so the last items may pass the budget by a few words: they are cut
    schedule = running(ordered, "words")
    kept = F.least(F.col("words"), F.greatest(F.lit(0), F.lit(budget) - (F.col("__upto") - F.col("words"))))
    schedule = schedule.withColumn("kept", kept).where("kept > 0").select(
        "row_id", "pass", F.col("kept").alias("words"), (F.col("whole") & (F.col("kept") == F.col("words"))).alias("whole"), "virtual_finish", (F.col("__upto") - F.col("words")).alias("mixed_before")
    )
    documents = narrow.join(sources.select(*KEY, "source_size", "target"), KEY).select("row_id", "doc_id", "source", "size", "source_size", "target")
    return documents, schedule


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(Scratch(spark, "mixing"), table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    documents, schedule = mix(docs, row="__row")
    rows = documents.withColumn("taken", F.lit(0)).unionByName(schedule.select("row_id", F.col("words").alias("taken")), allowMissingColumns=True)
    first = [F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return rows.groupBy("row_id").agg(*first, F.sum("taken").cast("long").alias("taken")).drop("row_id")
