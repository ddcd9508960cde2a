"""Operator 2: shards cut from a Hilbert curve over metadata (DataFrame functions only).

Three metadata dimensions (language, source and size) are quantised to 2^BITS
levels at their quantiles: a language or source has the level of the share of rows
that stand before it in string order. The rows are sorted along the Hilbert curve through
that grid, rows of a cell by the checksum of their text, so that equal texts of a
cell stand together, then by doc_id and the number of the row, so that no key repeats. Runs of that order are the shards: files
that each cover a small box of the grid, which min/max statistics can prune in
every dimension. The law is ``rows``: shard sizes differ by one row at most.

Text is read once, for its size and checksum; only the narrow rows are sorted, by
ranges of a unique key, so a frequent language or source fills no single task.

Edge cases: null text counts 0 bytes and has the checksum of the empty text; null
metadata count as empty strings; fewer rows than shards leave shards empty; repeated rows
each get a slot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, numbered, table
from .ordering import globally_sorted, ranked, running

SHARDS, BITS, OVERHEAD = 40, 4, 16


def string_levels(scratch: Scratch, rows: DataFrame, column: str, bits: int) -> DataFrame:
    """column and its level for every distinct value; the values are ordered by ranges, not in one task."""
    values = globally_sorted(scratch, rows.groupBy(column).agg(F.count("*").alias("n")), [column])
    before = F.col("__upto") - F.col("n")
    return running(values, "n").select(column, F.floor(before * (1 << bits) / F.col("__total")).cast("int").alias(f"level_{column}"))


def hilbert(levels: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with one level of so many bits a dimension."""
    n, top = len(levels), 1 << (bits - 1)

    def untangle(s: Column, q: Column) -> Column:
        x = [s[f"x{i}"] for i in range(n)]
        p = q - 1
        for i in range(n):
            on = x[i].bitwiseAND(q) != 0
            t = x[0].bitwiseXOR(x[i]).bitwiseAND(p)
            first = F.when(on, x[0].bitwiseXOR(p)).otherwise(x[0].bitwiseXOR(t))
            own = F.when(on, x[i]).otherwise(x[i].bitwiseXOR(t))
            x = [first if k == 0 else own if k == i else x[k] for k in range(n)] if i else [first, *x[1:]]
        return F.struct(*(c.alias(f"x{k}") for k, c in enumerate(x)))

    start = F.struct(*(c.cast("int").alias(f"x{k}") for k, c in enumerate(levels)))
    steps = F.array(*(F.lit(top >> k) for k in range(bits - 1)))
    s = F.aggregate(steps, start, untangle)

    def gray(s: Column) -> Column:
        x = [s["x0"]]
        for i in range(1, n):
            x.append(s[f"x{i}"].bitwiseXOR(x[-1]))
        t = F.aggregate(steps, F.lit(0), lambda t, q: F.when(x[-1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        place = F.lit(0)
        for b in reversed(range(bits)):
            for i in range(n):
                place = place * 2 + F.shiftright(x[i].bitwiseXOR(t), b).bitwiseAND(F.lit(1))
        return place

    return F.element_at(F.transform(F.array(s), gray), 1)


def level(c: Column, cuts: list) -> Column:
    """How many of the quantile cuts lie below the value; null is level 0."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*(F.lit(x) for x in cuts)), lambda x: x < c)), F.lit(0))


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve (the Hilbert place)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = numbered(scratch, docs.select("doc_id", "text", "lang", "source"))
    narrow = scratch.save(
        docs.select(
            F.col("__row").alias("number"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.octet_length(text).cast("long").alias("bytes"),
        )
    )
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    # 2^bits - 1 cuts
    cuts = narrow.agg(F.percentile_approx("bytes", steps, 10_000).alias("bytes")).first()["bytes"]
    levelled = narrow
    for column in ("lang", "source"):
        # as many rows as values: Spark broadcasts them only under its own size limit
        levelled = levelled.join(scratch.save(string_levels(scratch, narrow, column, bits)), column)
    place = hilbert([F.col("level_lang"), F.col("level_source"), level(F.col("bytes"), sorted(set(cuts or [])))], bits)
    ordered = globally_sorted(scratch, levelled.select("doc_id", "size", "text_crc32", place.alias("curve"), "number"), ["curve", "text_crc32", "doc_id", "number"])
    scratch.drop(narrow)
    out = ranked(ordered)
    base, extra = F.expr(f"__total div {shards}"), F.col("__total") % shards
    big = extra * (base + 1)  # rows in the shards that have one more
    rank = F.col("__rank")
    number = F.when(rank < big, F.floor(rank / (base + 1))).otherwise(extra + F.floor((rank - big) / F.greatest(base, F.lit(1))))
    first = F.when(F.col("shard") <= extra, F.col("shard") * (base + 1)).otherwise(big + (F.col("shard") - extra) * base)
    return out.withColumn("shard", number.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (rank - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
