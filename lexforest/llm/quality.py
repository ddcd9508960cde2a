"""Operator 1: quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are pairs of neighbouring character classes, hashed words, and
repeats of the word before. Their relative frequencies (square roots, so that
long texts don't differ from short ones) are projected on the leading singular
vectors of the labelled rows. The labelled vectors are broadcast; every document
is compared with all of them by exact cosine products, block by block, and its
score is the similarity-weighted mean label of its nearest neighbours.

The labelled rows are a bounded sample (``max_labelled``, the smallest hashes of
doc_id), so the broadcast is at most max_labelled x rank floats whatever the
input. Every document is scored over its whole text in one narrow pass.

Edge cases: null and empty texts (and texts of white space) have no direction
and score the mean label; repeated labels of a doc_id count once, by majority,
ties as good; null labels are left out; without any labelled row every score is
0.5; without both labels every score is that label's; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_documents, slices, string_bytes, table, words_of

FOLDS = 5
#: Bound of the labelled sample.
MAX_LABELLED = 4096
RANK, NEIGHBOURS, THRESHOLD = 48, 15, 0.3
WORD_BUCKETS, CLASSES = 256, 32
N_TERMS = CLASSES * CLASSES + WORD_BUCKETS + 2
#: Weights of the blocks of terms: character pairs, words, repeats.
BLOCK_WEIGHTS = (1.0, 0.5, 1.0)
BLOCK = 1024
#: Labelled rows that the driver spells out at once.
FIT_BLOCK = 256
#: Weight of the mean label in a text of one word; neighbours have NEIGHBOURS together at most.
LEAN = 30.0

_CLASS = np.full(256, 31, np.int64)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[32], _CLASS[[9, 10, 11, 12, 13]], _CLASS[128:] = 3, 4, 5
for _k, _c in enumerate(".,!?|%$#&*'\"-_:;()/@<>=+~"):
    _CLASS[ord(_c)] = 6 + _k


def terms(text) -> tuple[np.ndarray, np.ndarray]:
    """Rows of term weights of an Arrow string column, and the texts' numbers of words."""
    buf, off = string_bytes(text)
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    cls = _CLASS[buf]
    same = doc[1:] == doc[:-1]
    pairs = (doc[:-1] * CLASSES + cls[:-1]) * CLASSES + cls[1:]
    chars = np.bincount(pairs[same], minlength=n * CLASSES * CLASSES).reshape(n, -1).astype(np.float32)
    _, _, of, h = words_of(buf, off)
    words = np.bincount(of * WORD_BUCKETS + (h % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=n * WORD_BUCKETS).reshape(n, -1).astype(np.float32)
    again = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    total = np.bincount(of, minlength=n)
    rep = np.bincount(of[1:][again], minlength=n)
    repeats = np.stack([rep, total - rep], axis=1).astype(np.float32)
    out = [np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1)) * w for x, w in zip((chars, words, repeats), BLOCK_WEIGHTS, strict=True)]
    x = np.concatenate(out, axis=1)
    x[total == 0] = 0  # no words, no terms
    return x, total


@dataclass
class Voter:
    """What is broadcast: the projection and the labelled vectors."""

    mean: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, blocks: Callable[[], Iterable[np.ndarray]], labels: np.ndarray, rank: int) -> "Voter":
        """blocks gives the rows of terms, some at a time, at each call. What is held is a square of the number of terms."""
        n, total, products = len(labels), np.zeros(N_TERMS), np.zeros((N_TERMS, N_TERMS))
        for x in blocks():
            x = x.astype(np.float64)
            total += x.sum(0)
            products += x.T @ x
        mean = total / n
        products -= np.outer(total, mean)
        # the leading singular vectors of the centred rows, largest first
        basis = np.linalg.eigh(products)[1][:, : -1 - min(rank, n) : -1]
        self = cls(mean.astype(np.float32), np.ascontiguousarray(basis, np.float32), np.zeros((0, rank), np.float32), labels.astype(np.float32))
        self.vectors = np.concatenate([self.latent(x) for x in blocks()])
        return self

    def latent(self, x: np.ndarray) -> np.ndarray:
        """Unit rows; rows without terms are 0."""
        z = (x - self.mean) @ self.basis
        z[~x.any(1)] = 0
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def vote(self, x: np.ndarray, n_words: np.ndarray, neighbours: int) -> np.ndarray:
        """Weighted mean label of the neighbours; a text of few words says little, and leans to the mean label."""
        prior, k = float(self.labels.mean()), min(neighbours, len(self.labels))
        out = np.empty(len(x))
        for a in range(0, len(x), BLOCK):
            z = self.latent(x[a : a + BLOCK])
            cos = z @ self.vectors.T
            near = np.argpartition(cos, len(self.labels) - k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0) ** 4
            lean = LEAN / np.maximum(n_words[a : a + BLOCK], 1)
            out[a : a + BLOCK] = ((w * self.labels[near]).sum(1) + lean * prior) / (w.sum(1) + lean)
        return np.clip(out, 0, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, folds: int) -> DataFrame:
    """doc_id, label and text of at most bound labelled rows outside fold 0."""
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id").agg(F.when(F.avg("label") >= 0.5, 1).otherwise(0).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    # at most bound small rows
    return as_documents(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fold(doc_id, folds: int = FOLDS):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rank: int = RANK, folds: int = FOLDS) -> Voter | None:
    import pyarrow as pa

    def features(batches):
        for batch in batches:
            for a, b in slices(batch.column(2)):
                x, _ = terms(batch.column(2).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    rows = labelled_sample(docs, labels, max_labelled, folds).select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, x binary").toArrow()
    if not len(rows):
        return None
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")

    def blocks():
        for a in range(0, len(order), FIT_BLOCK):
            yield np.stack([np.frombuffer(x, np.float32) for x in rows.column("x").take(order[a : a + FIT_BLOCK]).to_pylist()])

    voter = Voter.fit(blocks, rows.column("label").to_numpy()[order], rank)
    del rows
    pa.default_memory_pool().release_unused()  # else the driver keeps the rows' pages for later queries
    return voter


def score(docs: DataFrame, voter: Voter | None, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD, keep: list[str] = ()) -> DataFrame:
    """The columns of keep, score and predicted. text is read, and returned only if kept."""
    spark = docs.sparkSession
    keep = [c for c in keep if c != "text"] + [c for c in keep if c == "text"]
    src = docs.select(*(c for c in keep if c != "text"), F.col("text").cast("string").alias("text"))
    fields = src.schema.fields[: len(keep)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double, predicted int"])
    shared = spark.sparkContext.broadcast(voter)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            text = batch.columns[-1]
            for a, b in slices(text):
                x, n_words = terms(text.slice(a, b - a))
                s = model.vote(x, n_words, neighbours) if model is not None else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(keep)]), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return src.mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
