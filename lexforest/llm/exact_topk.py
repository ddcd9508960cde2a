"""Operator 6: exact top-k by inner product with a Voronoi partition.

Vectors and queries are grouped by their nearest pivot. A summary of each group
(size, radius, largest norm, and the k + 1 smallest distances to its pivot, of
rows of different vec_id) gives, for a query q and a group with pivot p and radius r,

    q.x <= min(q.p + |q| r, |q| max|x|)      for every x of the group
    q.x >= q.p - |q| d                       for an x at distance d,

so the summaries alone give a score that k candidates of another vec_id than the
query's reach. The same bounds for a whole group of queries (with their distance to the group's
pivot as slack) tell which groups of vectors a group of queries may need at
all; among those a query is sent only to the groups whose own bound reaches its score. Each group is cut into blocks of
bounded size by a hash of the row's number (a vector or vec_id with
many copies fills many blocks, not one), each block answers its queries by one exact product of whole numbers,
and the blocks' best k are merged per query. Queries meet a block in chunks of bounded size. Nothing is left out: a group is
skipped only if its bound is below what k other candidates reach.

In a block, rows are sorted by distance to the pivot and only those beyond the
least useful distance, (score to reach - q.p) / |q|, are multiplied.

Edge cases: a vector that is null, empty, of another length than most, or holds a
null or non-finite component takes no part, as query or candidate; fewer than k
candidates give all of them; rows that share a vec_id are separate candidates of
the others and never answer their own id, and each of them that is a query has its own k rows in the result; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .vectors import choose_pivots, exact_products, matrix, top_rows, usable

K, QUERY_EVERY, SCALE = 5, 50, 256
#: Rows of a block and queries multiplied at once.
BLOCK, QUERY_BLOCK = 4096, 512
#: Queries that a block meets in one group.
CHUNK = 8192
#: Bounds of the number of pivots, which grows with the square root of the rows.
PIVOTS = (4, 512)
SEED = 6


def assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """row, vec_id, v, cell (nearest pivot) and distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        import pyarrow as pa

        p = shared.value
        for batch in batches:
            x = matrix(batch.column(2))
            if not len(x):
                continue
            d2 = (x * x).sum(1)[:, None] - 2 * (x @ p.T) + (p * p).sum(1)
            cell = d2.argmin(1)
            distance = np.linalg.norm(x - p[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell.astype(np.int32)), pa.array(distance)], names=["row", "vec_id", "v", "cell", "distance"])

    return df.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, v array<double>, cell int, distance double")


class Summaries:
    """Bounds that hold for every candidate of a cell; one row a pivot."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, norm: np.ndarray, near: list[list[tuple[float, int]]], k: int):
        self.pivots, self.radius, self.norm, self.k = pivots, radius, norm, k
        self.of = np.repeat(np.arange(len(pivots)), [len(x) for x in near])
        self.near = np.array([d for x in near for d, _ in x], np.float64)
        self.ids = np.array([i for x in near for _, i in x], np.int64)

    def group_needs(self, radius: np.ndarray) -> np.ndarray:
        """Query groups x cells: whether a query at most so far from its group's pivot may need the cell."""
        product, length = self.pivots @ self.pivots.T, np.linalg.norm(self.pivots, axis=1)[:, None]
        spread = radius[:, None] * self.norm
        slack = 1e-9 * (1 + self.norm.max(initial=0)) * (1 + length + radius[:, None])
        upper = np.minimum(product + length * self.radius + spread, (length + radius[:, None]) * self.norm) + slack
        lower = product[:, self.of] - length * self.near - spread[:, self.of] - slack
        # one of the nearest may be the query's own vec_id
        k = self.k + 1
        reach = np.full(len(radius), -np.inf) if lower.shape[1] < k else np.partition(lower, -k, axis=1)[:, -k]
        return upper >= reach[:, None]

    def needed(self, q: np.ndarray, q_ids: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries x cells that may hold one of the best k, the score that k candidates reach); only the named cells are looked at."""
        chosen = np.isin(self.of, cells)
        s = Summaries(self.pivots[cells], self.radius[cells], self.norm[cells], [[] for _ in cells], self.k)
        s.of, s.near, s.ids = np.searchsorted(cells, self.of[chosen]), self.near[chosen], self.ids[chosen]
        found, reach = s._needed(q, q_ids)
        out = np.zeros((len(q), len(self.pivots)), bool)
        out[:, cells] = found
        return out, reach

    def _needed(self, q: np.ndarray, q_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slack = 1e-9 * (1 + self.norm.max(initial=0)) * (1 + np.linalg.norm(q, axis=1, keepdims=True))  # of doubles
        length = np.linalg.norm(q, axis=1, keepdims=True)
        product = q @ self.pivots.T
        upper = np.minimum(product + length * self.radius, length * self.norm) + slack
        lower = product[:, self.of] - length * self.near - slack
        # rows of the query's own vec_id are no candidates
        lower[q_ids[:, None] == self.ids] = -np.inf
        reach = np.full(len(q), -np.inf) if lower.shape[1] < self.k else np.partition(lower, -self.k, axis=1)[:, -self.k]
        return upper >= reach[:, None], reach


def solve_block(cell_pivot: np.ndarray, ids, x, distance, q_ids, q, reach, k: int):
    """(index of the query, vec_id, score) of the best k of one block for each of its queries."""
    order = np.argsort(-distance, kind="stable")
    ids, x, distance = ids[order], x[order], distance[order]
    out = []
    for a in range(0, len(q), QUERY_BLOCK):
        part, part_ids = q[a : a + QUERY_BLOCK], q_ids[a : a + QUERY_BLOCK]
        length = np.linalg.norm(part, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(length > 0, (reach[a : a + QUERY_BLOCK] - part @ cell_pivot) / length, -np.inf)
        far = float(np.min(least, initial=np.inf)) * (1 - 1e-9) - 1e-6
        n = int(np.searchsorted(-distance, -far, side="right")) if np.isfinite(far) else len(x)
        if not n:
            continue
        scores = exact_products(part, x[:n])
        own = part_ids[:, None] == ids[None, :n]
        kept = np.where(own, np.iinfo(np.int64).min + 1, scores)
        best = top_rows(kept, ids[:n], k)
        rows = np.repeat(np.arange(len(part)), best.shape[1])
        flat = best.ravel()
        ok = ~own[rows, flat]
        out.append((a + rows[ok], ids[flat][ok], scores[rows, flat][ok]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def exact_topk(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products for every query row of vec_id, v (whole numbers)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    # written, so that a row has the same number at each reading
    rows = scratch.save(vectors.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    pivots = choose_pivots(rows, int(min(max(n**0.5 / 4, PIVOTS[0]), PIVOTS[1])), SEED)
    cells = scratch.save(assign(rows, pivots))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    parts = cells.withColumn("norm", norm)
    # a row a cell; the k + 1 nearest of a cell come from the nearest of its salted parts, each vec_id counted once
    salted = cells.groupBy("cell", "vec_id").agg(F.min("distance").alias("distance")).withColumn("salt", F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(64)))
    w = Window.partitionBy("cell", "salt").orderBy("distance", "vec_id")
    near = salted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("cell").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))), 1, k + 1).alias("near"))
    summary = {r.cell: r for r in parts.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.max("norm").alias("norm")).join(near, "cell").collect()}
    m = len(pivots)
    get = lambda name, empty: [summary[c][name] if c in summary else empty for c in range(m)]
    summaries = Summaries(pivots, np.array(get("radius", 0.0)), np.array(get("norm", 0.0)), get("near", []), k)
    counts = np.array(get("n", 0))
    blocks = np.maximum(1, -(-counts // BLOCK))
    asked = cells.where(is_query).select("row", "vec_id", "v", "cell", "distance")
    far = {r.cell: r.far for r in asked.groupBy("cell").agg(F.max("distance").alias("far")).collect()}
    groups = summaries.group_needs(np.array([far.get(c, 0.0) for c in range(m)]))
    shared = spark.sparkContext.broadcast((summaries, blocks, counts, groups))

    def send(batches):
        """A row for each query and block of a cell that it needs."""
        import pyarrow as pa

        s, per_cell, own, of_group = shared.value
        for batch in batches:
            group = batch.column(3).to_numpy()
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order])) + 1
            for part in (batch.take(pa.array(rows[a : a + QUERY_BLOCK])) for rows in np.split(order, edges) for a in range(0, len(rows), QUERY_BLOCK)):
                need, reach = s.needed(matrix(part.column(2)), part.column(1).to_numpy(), np.flatnonzero(of_group[part.column(3)[0].as_py()]))
                row, cell = np.nonzero(need & (own > 0))
                times = per_cell[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns[:3]), pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(reach[row])], names=["row", "vec_id", "v", "cell", "block", "reach"])

    sent = asked.mapInArrow(send, "row long, vec_id long, v array<double>, cell int, block int, reach double")
    block_counts = F.element_at(F.array(*(F.lit(int(b)) for b in blocks)), F.col("cell") + 1)
    chunks = max(1, -(-asked.count() // CHUNK))
    sent = scratch.save(sent.withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(chunks)).cast("int")))
    # a block is copied to the chunks with a query that needs it only
    wanted = sent.select("cell", "block", F.col("chunk").alias("chunk")).distinct()
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("row"), block_counts).cast("int")).join(wanted, ["cell", "block"])

    def solve(key, left, right):
        import pyarrow as pa

        s = shared.value[0]
        x, q = left.combine_chunks(), right.combine_chunks()
        one = lambda t, c: t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)
        names = ("query_row", "query_id", "vec_id", "score")
        if not len(x) or not len(q):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        q_ids = one(q, "vec_id").to_numpy()
        at, ids, scores = solve_block(s.pivots[key[0].as_py()], one(x, "vec_id").to_numpy(), matrix(one(x, "v")), one(x, "distance").to_numpy(), q_ids, matrix(one(q, "v")), one(q, "reach").to_numpy(), k)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, (one(q, "row").to_numpy()[at], q_ids[at], ids, scores), strict=True)})

    best = dealt.groupBy("cell", "block", "chunk").cogroup(sent.groupBy("cell", "block", "chunk")).applyInArrow(solve, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    whole = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")))
    return exact_topk(whole, F.col("vec_id") % QUERY_EVERY == 0)
