"""Operator 12: hard negatives by exact inner products of Kronecker-packed integers.

Components are made whole numbers and biased to be at least 0, so that an inner
product of a biased anchor and a biased candidate is a whole number of a known width. As many
candidates as fit side by side go into one wide integer a component, each in
a field of that width: one multiplication by an anchor's component serves all of them,
no sum can run into the next field, and the sums are unpacked and freed of the biases.
The wide integers have up to ``WIDE`` bits, all of which a double holds exactly, so a block
of anchors meets a block of packed candidates in one matrix product. Components too
large for two fields are multiplied in 64-bit integers.

First each anchor's positives are found: rows are dealt into blocks of one label, of a bounded size
whatever the label's share, and anchors go to the blocks of their own label. Then the anchors,
with the scores that their positives allow, meet all blocks in chunks, and each
block returns the best few different-label rows within the range of each positive.

Edge cases: rows with a null vec_id, label or vector, an empty vector, one of another
length than most, or a null or non-finite component take no part; an anchor without
positives or a positive without negatives gives no rows; rows that share a vec_id
are separate rows, none of which is a positive of another of them; an anchor row that stands
twice is answered twice; scores must fit 64 bits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .vectors import exact_products, matrix, usable

SCALE, ANCHOR_EVERY, MOVED_EVERY, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is from this percentage of the positive's up to all of it.
LEAST, MOST = 80, 100
WIDE = 53
#: Rows of a block, anchors of a chunk, and anchors multiplied at once.
BLOCK, CHUNK, TILE = 8192, 4096, 256


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x candidates) of rows of whole numbers held as doubles."""
    low_a, low_c = min(0.0, float(anchors.min(initial=0))), min(0.0, float(candidates.min(initial=0)))
    dims = anchors.shape[1]
    # in Python's integers, which have no bound
    width = max(1, (dims * int(anchors.max(initial=0) - low_a) * int(candidates.max(initial=0) - low_c)).bit_length())
    fields = WIDE // width
    if fields < 2:
        return exact_products(anchors, candidates)
    a, c = anchors - low_a, candidates - low_c
    n = len(c)
    spare = -n % fields
    grouped = np.concatenate([c, np.zeros((spare, dims))]).reshape(-1, fields, dims)
    wide = np.tensordot(2.0 ** (width * np.arange(fields)), grouped, axes=(0, 1))
    sums = (a @ wide.T).astype(np.int64)
    out = np.empty((len(a), len(wide), fields), np.int64)
    for k in range(fields):
        out[:, :, k] = (sums >> (width * k)) & ((1 << width) - 1)
    out = out.reshape(len(a), -1)[:, :n]
    # (a + x)(c + y) = ac + y a + x c + xy, summed over the components
    low_a, low_c = int(low_a), int(low_c)
    return out + low_c * a.sum(1).astype(np.int64)[:, None] + low_a * c.sum(1).astype(np.int64)[None, :] + dims * low_a * low_c


def best_of(allowed: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest allowed scores of each row, ties to the smaller id."""
    row, col = np.nonzero(allowed)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def labelled(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (whole numbers) and label of the rows that take part; some labels are moved on by one."""
    known = embeddings.where(F.col("label").isNotNull()).select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("double"))
    return usable(known, keep=("label",)).select("vec_id", whole.alias("v"), moved.alias("label"))


def _column(t, name: str):
    c = t.column(name)
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)


def positives_of(scratch: Scratch, rows: DataFrame, is_anchor: Column, k: int) -> DataFrame:
    """anchor (its row), anchor_id, rank, positive (its row), positive_id and positive_score."""
    salt = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    parts = lambda n, most: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    per = scratch.save(rows.groupBy("label").agg(parts(F.count("*"), BLOCK).alias("blocks"), parts(F.count_if(is_anchor), CHUNK).alias("chunks")))
    sized = rows.join(per, "label")
    data = sized.select("label", "row", "vec_id", "v", salt(F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    asked = sized.where(is_anchor).select(*(F.col(c).alias(c) for c in ("label", "row", "vec_id", "v")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), salt(F.col("chunks")).alias("chunk"))

    def solve(key, left, right):
        import pyarrow as pa

        found = [[] for _ in range(5)]
        if len(left) and len(right):
            x, ids, row = matrix(_column(left, "v")), _column(left, "vec_id").to_numpy(), _column(left, "row").to_numpy()
            q, q_ids, q_row = matrix(_column(right, "v")), _column(right, "vec_id").to_numpy(), _column(right, "row").to_numpy()
            for a in range(0, len(q), TILE):
                scores = products(q[a : a + TILE], x)
                r, c = best_of(q_ids[a : a + TILE, None] != ids[None, :], scores, ids, k)
                for out, values in zip(found, (q_row[a + r], q_ids[a + r], row[c], ids[c], scores[r, c]), strict=True):
                    out.append(values)
        return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(("anchor", "anchor_id", "positive", "positive_id", "positive_score"), found, strict=True)})

    keys = ["label", "block", "chunk"]
    best = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(solve, "anchor long, anchor_id long, positive long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, from vectors (vec_id, v, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = scratch.save(vectors.select("vec_id", "v", "label").withColumn("row", F.monotonically_increasing_id()))
    pairs = positives_of(scratch, rows, is_anchor, positives)
    # at most so many positives an anchor
    asked = pairs.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    asked = scratch.save(asked.join(rows.withColumnRenamed("row", "anchor"), "anchor"))
    blocks, chunks = max(1, -(-rows.count() // BLOCK)), max(1, -(-asked.count() // CHUNK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("vec_id", "v", "label", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), every(chunks).alias("chunk"))
    asked = asked.select("anchor", F.col("vec_id").alias("anchor_id"), "v", "label", "positives", F.pmod(F.xxhash64("anchor"), F.lit(chunks)).cast("int").alias("chunk"), every(blocks).alias("block"))
    names = ("anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")

    def solve(key, left, right):
        import pyarrow as pa

        found = [[] for _ in names]
        if len(left) and len(right):
            x, ids, label = matrix(_column(left, "v")), _column(left, "vec_id").to_numpy(), _column(left, "label").to_numpy()
            q, q_ids, q_row, q_label = matrix(_column(right, "v")), _column(right, "anchor_id").to_numpy(), _column(right, "anchor").to_numpy(), _column(right, "label").to_numpy()
            lists = _column(right, "positives")
            of = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            place, p_id, p_score = (flat.field(n).to_numpy() for n in ("rank", "positive_id", "positive_score"))
            for a in range(0, len(q), TILE):
                scores = products(q[a : a + TILE], x)
                other = q_label[a : a + TILE, None] != label[None, :]
                mine = np.flatnonzero((of >= a) & (of < a + TILE))
                for p in np.unique(place[mine]):
                    at = mine[place[mine] == p]
                    s, own = scores[of[at] - a], p_score[at, None]
                    r, c = best_of(other[of[at] - a] & (least * own <= 100 * s) & (100 * s <= most * own), s, ids, negatives)
                    for out, values in zip(found, (q_row[of[at][r]], q_ids[of[at][r]], np.full(len(r), p), p_id[at][r], p_score[at][r], ids[c], s[r, c]), strict=True):
                        out.append(values)
        return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(names, found, strict=True)})

    best = data.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(solve, ", ".join(f"{n} long" for n in names))
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(labelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % ANCHOR_EVERY == 0)
