"""Operator 9: approximate nearest neighbours with a permutation index.

Every vector is represented by its nearest pivots in order. It is posted under the first of them, its
cell, and cells are cut into blocks of a bounded size by a hash of the row, so
that neither a frequent vector nor a frequent vec_id fills one. A query goes to the blocks of the cells of its own
first pivots only. In each block a pivot's inverted file lists the
vectors that have it among their nearest, with its place in their order. The query
reads the files of its own nearest pivots, which gives each vector of the block
the footrule distance of the two orders (a pivot missing from one order counts as
just past its end), keeps the nearest share of the block, and reranks those by
exact cosine in double precision. The blocks' best are merged per query.

How many cells a query visits is fitted to the data: of a bounded sample (``SAMPLE`` rows of the
smallest hash of vec_id; the pivots are its first rows) every different vector's true neighbours are found, and
the least number of cells is taken that has ``FOUND`` of them. Vectors in clusters need few cells,
vectors without structure many. Every row is indexed. A block meets the queries in chunks of a
bounded size and is copied to the chunks that need it.

Edge cases: a vector that is null, empty, zero, of another length than most, or
holds a null or non-finite component takes no part; fewer than k candidates give
all of them; ties, of the footrule too, go to the smaller vec_id; rows that share a vec_id are separate
candidates of the others and never answer their own id, and each of them that is a query has its own k rows in the result;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .vectors import bounded_sample, matrix, top_rows, usable

K, QUERY_EVERY = 5, 50
PIVOTS, ORDER = 128, 64
#: Share of a block that is reranked, and a least number of its rows.
RERANK, RERANK_LEAST = 0.2, 64
BLOCK, CHUNK = 4096, 8192
#: Rows that the number of cells is fitted to, and the share of their neighbours that it finds.
SAMPLE, FOUND = 4096, 0.99
SEED = 9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither very large nor very small components overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Index:
    """The inverted files of a block: for each pivot the rows that list it and its place in their order."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, order: int):
        self.x, self.pivots, self.order = x, pivots, min(order, len(pivots))
        orders = self.orders(x)
        rows = np.repeat(np.arange(len(x)), self.order)
        places = np.tile(np.arange(self.order), len(x))
        by_pivot = np.argsort(orders.ravel(), kind="stable")
        cuts = np.searchsorted(orders.ravel()[by_pivot], np.arange(len(pivots) + 1))
        self.files = [(rows[by_pivot[a:b]], places[by_pivot[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def orders(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-(x @ self.pivots.T), axis=1, kind="stable")[:, : self.order]

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Of each row of the block, from a query's order, up to a constant of the query."""
        gain = np.zeros(len(self.x), np.int64)
        for place, pivot in enumerate(order.tolist()):
            rows, places = self.files[pivot]
            # apart, the two orders would pay for the pivot's absence on either side
            gain[rows] += (self.order - place) + (self.order - places) - np.abs(places - place)
        return -gain

    def candidates(self, order: np.ndarray, n: int) -> np.ndarray:
        if n >= len(self.x):
            return np.arange(len(self.x))
        # ties to the earlier row, since copies of one vector tie
        return np.argpartition(self.footrule(order) * len(self.x) + np.arange(len(self.x)), n - 1)[:n]


def search_block(ids, vectors, q_ids, queries, pivots, k: int, share: float):
    """(index of the query, vec_id, score) of the nearest k found in one block for each of its queries."""
    by_id = np.argsort(ids, kind="stable")
    ids, x, q = ids[by_id], unit(vectors[by_id]), unit(queries)
    index = Index(x, pivots, ORDER)
    n = max(RERANK_LEAST, int(len(x) * share))
    out_q, out_v, out_s = [], [], []
    for r, order in enumerate(index.orders(q)):
        near = index.candidates(order, n)
        near = near[ids[near] != q_ids[r]]
        scores = (x[near] * q[r]).sum(1)
        best = top_rows(scores[None], ids[near], k)[0] if len(near) else np.zeros(0, np.int64)
        out_q.append(np.full(len(best), r))
        out_v.append(ids[near][best])
        out_s.append(scores[best])
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (out_q, out_v, out_s)]


def cells_needed(sample: np.ndarray, pivots: np.ndarray, k: int, found: float) -> int:
    """How many cells, of a query's nearest pivots, hold the share found of the k nearest of the sample's different vectors."""
    x = unit(np.unique(sample, axis=0))
    place = np.empty((len(x), len(pivots)), np.int64)
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    np.put_along_axis(place, order, np.arange(len(pivots))[None, :], 1)
    cell, needed = order[:, 0], []
    for a in range(0, len(x), 512):
        scores = x[a : a + 512] @ x.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -2
        near = np.argpartition(-scores, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(scores), 0), np.int64)
        needed.append(np.take_along_axis(place[a : a + 512], cell[near], 1).ravel())
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(np.ceil(found * len(needed))))]) + 1 if len(needed) else len(pivots)


def permutation_search(vectors: DataFrame, is_query, k: int = K, n_pivots: int = PIVOTS, share: float = RERANK, found: float = FOUND) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of the k nearest found for every query row of vec_id, v."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "permutation")
    # written, so that a row has the same number at each reading
    rows = scratch.save(vectors.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()))
    sample = bounded_sample(rows, SAMPLE, SEED)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = unit(np.unique(sample[:n_pivots], axis=0))
    cells = cells_needed(sample, pivots, k, found)
    shared = spark.sparkContext.broadcast(pivots)

    def post(n):
        """The rows, once for each of the cells of their first n pivots."""

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for a in range(0, len(batch), 4096):
                    part = batch.slice(a, 4096)
                    order = np.argsort(-(unit(matrix(part.column(2))) @ shared.value.T), axis=1, kind="stable")[:, :n]
                    take = pa.array(np.repeat(np.arange(len(part)), order.shape[1]))
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns), pa.array(order.ravel().astype(np.int32))], names=["row", "vec_id", "v", "cell"])

        return lambda df: df.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, v array<double>, cell int")

    posted = scratch.save(post(1)(rows))
    # a row a pivot
    per = posted.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    per = scratch.save(per)
    data = posted.join(F.broadcast(per), "cell").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    asked = rows.where(is_query)
    chunks = max(1, -(-asked.count() // CHUNK))
    sent = post(cells)(asked).join(F.broadcast(per), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = scratch.save(sent.withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(chunks)).cast("int")).drop("blocks"))
    data = data.join(sent.select("cell", "block", F.col("chunk").alias("chunk")).distinct(), ["cell", "block"])
    names = ("query_row", "query_id", "vec_id", "score")

    def solve(key, left, right):
        import pyarrow as pa

        one = lambda t, c: t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)
        columns = [np.zeros(0)] * 4
        if len(left) and len(right):
            q_ids = one(right, "vec_id").to_numpy()
            at, ids, scores = search_block(one(left, "vec_id").to_numpy(), matrix(one(left, "v")), q_ids, matrix(one(right, "v")), shared.value, k, share)
            columns = [one(right, "row").to_numpy()[at], q_ids[at], ids, scores]
        return pa.table({n: pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(names, columns, strict=True)})

    keys = ["cell", "block", "chunk"]
    best = data.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_search(usable(table(spark, sf_dir, "embeddings"), allow_zero=False), F.col("vec_id") % QUERY_EVERY == 0)
