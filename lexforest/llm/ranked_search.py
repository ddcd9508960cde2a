"""Operator 11: ranked lexical search over an inverted index with block-max MaxScore.

The index is a table of shards, each of consecutive documents of about ``SHARD_BYTES``
of text. A shard holds a postings list a term: document numbers as differences, and
frequencies, both in as few bytes as the list's largest value takes. A list is cut into
blocks of ``BLOCK`` postings; beside a block stand its last document and its undominated pairs
of frequency and document length. A score rises with the one and falls with the other, so these few
pairs give the block's exact maximum for whatever corpus statistics come later; the statistics
(documents, terms, documents that hold a term) are sums over the shards.

A shard answers an item document window by window. Its lists are ordered by their
largest possible contribution. Those whose contributions sum to less than the 20th score so
far are non-essential: a document that stands only in these cannot get in. The essential lists
of a window are read and added up; a document goes on to the next non-essential
list only if its sum, the maximum of the one block that may hold it and what the other lists
can add reach the 20th score, and only blocks that such documents need are unpacked. The
20th score goes on to the next shard of the task. Each task gives its best 20 an
item, and a window by item merges them.

All of a score is 64-bit integers, but for the logarithm in a term's weight. Terms
are told apart by a 64-bit hash. Terms that no item has are left out of the postings as long as
the items' terms are few enough to be broadcast (VOCABULARY); beyond that all terms are
posted. Items are answered in chunks of a bounded number of terms, each in one pass over the index.

Edge cases: null and empty texts have no terms; repeated rows are separate documents; a
null doc_id comes after all others of its score; rows of one item_id are one item, which has the
terms of its different texts; a null item_id is no item; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, string_bytes, string_sizes, table, words_of

K = 20
BLOCK, WINDOW = 128, 2048
SHARD_BYTES = 16 << 20
#: Terms of all items that are broadcast to thin the postings, and rows (item, term) of a chunk.
VOCABULARY, CHUNK = 1 << 20, 1 << 18
#: Fixed values of the ranking function.
ONE, TF, NORM, FLAT, LONG = 1_000_000_000, 1000, 12, 75, 25

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that part terms: ASCII, but for digits and letters.
_PARTS = np.zeros(256, bool)
_PARTS[:128] = True
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _PARTS[_a : _b + 1] = False

SHARD = "n_docs long, n_terms long, ids binary, nulls long, lengths binary, terms binary, counts binary, doc_width binary, tf_width binary, docs binary, tfs binary, last binary, pairs binary, pair_tf binary, pair_length binary"


def terms_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every term of an Arrow string column, in order of the texts."""
    buf, off = string_bytes(column)
    _, _, doc, h = words_of(_LOWER[buf], off, _PARTS)
    return doc, h


def pack_bytes(values: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, bytes]:
    """Widths in bytes (1, 2, 4 or 8) of n lists and all their values; of: the list of each value, in order."""
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, values)
    width = np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8)
    per = width[of]
    at = np.cumsum(per) - per
    out = np.zeros(int(per.sum()), np.uint8)
    for b in range(8):
        wide = per > b
        if not wide.any():
            break
        out[at[wide] + b] = (values[wide] >> (8 * b)) & 255
    return width.astype(np.uint8), out.tobytes()


def seal(ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, block: int = BLOCK) -> dict:
    """A shard of documents (ids, whether they are known, lengths) and postings (doc, term, tf); documents are numbered by id, unknown ones last."""
    order = np.lexsort((ids, ~known))
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    ids, lengths = ids[order], lengths[order]
    doc = number[doc]
    by = np.lexsort((doc, term))
    doc, term, tf = doc[by], term[by], tf[by]
    terms, first, counts = np.unique(term, return_index=True, return_counts=True)
    of = np.repeat(np.arange(len(terms)), counts)
    before = np.concatenate([[-1], doc[:-1]])
    before[first] = -1
    doc_width, docs = pack_bytes(doc - before - 1, of, len(terms))
    tf_width, tfs = pack_bytes(tf - 1, of, len(terms))
    place = np.arange(len(doc)) - first[of]
    new = place % block == 0
    number_of_block = np.cumsum(new) - 1
    ends = np.flatnonzero(np.append(new[1:], True)) if len(doc) else np.zeros(0, np.int64)
    # by falling frequency, a pair is undominated if its document is shorter than all before it in the block
    by = np.lexsort((lengths[doc], -tf, number_of_block))
    b, t, n = number_of_block[by], tf[by], lengths[doc][by]
    span = int(lengths.max(initial=0)) + 1
    low = np.minimum.accumulate(n - b * span) + b * span if len(n) else n
    same = np.concatenate([[False], b[1:] == b[:-1]]) if len(b) else np.zeros(0, bool)
    kept = ~same | (n < np.concatenate([[0], low[:-1]])) if len(b) else same
    pairs = np.bincount(b[kept], minlength=len(ends))
    raw = {"ids": ids, "lengths": lengths, "terms": terms, "counts": counts, "doc_width": doc_width, "tf_width": tf_width, "last": doc[ends].astype(np.int32), "pairs": pairs, "pair_tf": t[kept], "pair_length": n[kept]}
    out = {k: v.tobytes() for k, v in raw.items()} | {"docs": docs, "tfs": tfs}
    return out | {"n_docs": len(ids), "n_terms": int(lengths.sum()), "nulls": int((~known).sum())}


def build_index(docs: DataFrame, vocabulary: np.ndarray | None, shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """The shards of docs (doc_id, text); postings of the sorted term hashes in vocabulary only, if there is one."""
    shared = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in SHARD.split(", ")]
        parts, n, size = [], 0, 0

        def flush():
            ids, known, lengths, doc, term, tf = (np.concatenate(c) for c in zip(*parts, strict=True))
            shard = seal(ids, known, lengths, doc, term, tf, block)
            types = {"n_docs": pa.int64(), "n_terms": pa.int64(), "nulls": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([shard[c]], types.get(c, pa.binary())) for c in names], names=names)

        for batch in batches:
            for a, b in slices(batch.column(1)):
                text, own = batch.column(1).slice(a, b - a), batch.column(0).slice(a, b - a)
                doc, term = terms_of(text)
                lengths = np.bincount(doc, minlength=b - a)
                if shared is not None:
                    v = shared.value
                    found = np.searchsorted(v, term)
                    held = np.zeros(len(term), bool)
                    if len(v):
                        held = v[np.minimum(found, len(v) - 1)] == term
                    doc, code, uniq = doc[held], found[held], v
                else:
                    uniq, code = np.unique(term, return_inverse=True)
                key, tf = np.unique(doc * max(1, len(uniq)) + code, return_counts=True)
                doc, code = np.divmod(key, max(1, len(uniq)))
                # documents without terms take no part
                some = lengths > 0
                number = np.cumsum(some) - 1
                known = own.is_valid().to_numpy(zero_copy_only=False)[some]
                ids = own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[some]
                parts.append((ids, known, lengths[some].astype(np.int64), number[doc] + n, uniq[code], tf.astype(np.int64)))
                n += int(some.sum())
                size += int(string_sizes(text).sum())
                if size >= shard_bytes:
                    if n:
                        yield flush()
                    parts, n, size = [], 0, 0
        if n:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SHARD)


class Shard:
    """A shard with the maxima of its blocks under given statistics."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, block: int = BLOCK):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.row, self.block = row, block
        self.ids, self.nulls = read("ids", np.int64), row["nulls"]
        self.norm = NORM * (FLAT + (LONG * read("lengths", np.int64) * n_docs) // n_terms)
        self.terms, self.counts = read("terms", np.uint64), read("counts", np.int64)
        self.width = read("doc_width", np.uint8).astype(np.int64), read("tf_width", np.uint8).astype(np.int64)
        start = lambda sizes: np.concatenate([[0], np.cumsum(sizes)])
        self.at = tuple(start(self.counts * w) for w in self.width)
        self.first_block = start(-(-self.counts // block))
        self.last = read("last", np.int32)
        tf, length = read("pair_tf", np.int64), read("pair_length", np.int64)
        pair = self.part(tf, NORM * (FLAT + (LONG * length * n_docs) // n_terms))
        self.block_most = np.maximum.reduceat(pair, start(read("pairs", np.int64))[:-1]) if len(pair) else pair
        self.list_most = np.maximum.reduceat(self.block_most, self.first_block[:-1]) if len(self.terms) else pair
        self.unpacked = 0

    @staticmethod
    def part(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (ONE * tf) // (TF * tf + norm)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The list of each term, -1 if there is none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def lasts(self, x: int) -> np.ndarray:
        return self.last[self.first_block[x] : self.first_block[x + 1]]

    def unpack(self, x: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and contributions (without the weight) of blocks a up to b of list x."""
        lo, hi = a * self.block, min(b * self.block, int(self.counts[x]))
        self.unpacked += b - a

        def values(which: int, name: str) -> np.ndarray:
            w, at = int(self.width[which][x]), int(self.at[which][x])
            return np.frombuffer(self.row[name], f"<u{w}", hi - lo, at + lo * w).astype(np.int64)

        doc = np.cumsum(values(0, "docs") + 1) + (int(self.lasts(x)[a - 1]) if a else -1)
        return doc, self.part(values(1, "tfs") + 1, self.norm[doc])


class Top:
    """The best k (score, id, whether it is known) of an item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        #: a score below this cannot get in
        self.least = 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        s, i, w = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.known, known])
        order = np.lexsort((i, ~w, -s))[: self.k]
        self.scores, self.ids, self.known = s[order], i[order], w[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def search_shard(shard: Shard, terms: np.ndarray, weights: np.ndarray, top: Top, window: int = WINDOW) -> None:
    """Adds the shard's best documents of an item (its terms and their weights times their number) to top."""
    found = shard.find(terms)
    here = np.flatnonzero((found >= 0) & (weights > 0))
    if not len(here):
        return
    lists, weight = found[here], weights[here]
    most = weight * shard.list_most[lists]
    order = np.argsort(most, kind="stable")
    lists, weight, most = lists[order].tolist(), weight[order].tolist(), most[order]
    upto = np.cumsum(most)
    n = len(shard.ids)
    known_below = n - shard.nulls
    for a in range(0, n, window):
        b = min(a + window, n)
        essential = int(np.searchsorted(upto, top.least))  # the sum of all lists before this one stays below
        if essential == len(lists):
            return
        sums = np.zeros(b - a, np.int64)
        for k in range(essential, len(lists)):
            x, lasts = lists[k], shard.lasts(lists[k])
            i, j = np.searchsorted(lasts, [a, b - 1])
            if i == len(lasts):
                continue
            doc, part = shard.unpack(x, int(i), min(int(j) + 1, len(lasts)))
            lo, hi = np.searchsorted(doc, [a, b])
            sums[doc[lo:hi] - a] += weight[k] * part[lo:hi]
        rest = int(upto[essential - 1]) if essential else 0
        alive = np.flatnonzero((sums > 0) & (sums + rest >= top.least))
        for k in range(essential - 1, -1, -1):
            if not len(alive):
                break
            x, lasts = lists[k], shard.lasts(lists[k])
            rest -= int(most[k])
            at = np.searchsorted(lasts, alive + a)
            may = at < len(lasts)
            bound = np.zeros(len(alive), np.int64)
            bound[may] = weight[k] * shard.block_most[shard.first_block[x] + at[may]]
            good = sums[alive] + bound + rest >= top.least
            alive, at, may = alive[good], at[good], may[good]
            wanted = np.unique(at[may])
            for run in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1) if len(wanted) else ():
                doc, part = shard.unpack(x, int(run[0]), int(run[-1]) + 1)
                where = np.minimum(np.searchsorted(doc, alive + a), len(doc) - 1)
                hit = doc[where] == alive + a
                sums[alive[hit]] += weight[k] * part[where[hit]]
            alive = alive[sums[alive] + rest >= top.least]
        if len(alive):
            doc = alive + a
            top.add(sums[alive], shard.ids[doc], doc < known_below)


def weights_of(n_docs: int, df: dict[int, int], terms: np.ndarray, times: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(int(t), 0) + 1))) * int(m) for t, m in zip(terms, times, strict=True)], np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (hash as a long) and times of every item (item_id, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in slices(batch.column(1)):
                doc, term = terms_of(batch.column(1).slice(a, b - a))
                uniq, code = np.unique(term, return_inverse=True)
                key, times = np.unique(doc * max(1, len(uniq)) + code, return_counts=True)
                doc, code = np.divmod(key, max(1, len(uniq)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(uniq[code].view(np.int64)), pa.array(times.astype(np.int64))], names=["item_id", "term", "times"])

    texts = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return texts.mapInArrow(run, "item_id long, term long, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES, block: int = BLOCK, window: int = WINDOW, vocabulary: int = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (doc_id, text) of every item (item_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked-search")
    schema = "item_id long, rank int, doc_id long, score long"
    asked = scratch.save(item_terms(items))
    rows, distinct = asked.agg(F.count("*"), F.count_distinct("term")).first()
    # at most vocabulary rows, or none
    known = None
    if distinct <= vocabulary:
        known = np.sort(asked.select("term").distinct().toArrow().column(0).to_numpy().view(np.uint64)) if distinct else np.zeros(0, np.uint64)
    index = scratch.save(build_index(docs, known, shard_bytes, block))
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    if not rows or not n_docs:
        return spark.createDataFrame([], schema)
    chunks = -(-rows // chunk)
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(chunks)))
    best = None
    for c in range(chunks):
        # about chunk rows; all rows of an item are in one chunk
        own = asked.where(F.col("chunk") == c).orderBy("item_id").toArrow()
        found = answers(spark, index, *(own.column(x).to_numpy() for x in ("item_id", "term", "times")), n_docs, n_terms, k, block, window)
        best = found if best is None else best.union(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def answers(spark: SparkSession, index: DataFrame, item: np.ndarray, term: np.ndarray, times: np.ndarray, n_docs: int, n_terms: int, k: int, block: int, window: int) -> DataFrame:
    """item_id, doc_id and score: each task's best k documents of every item."""
    vocabulary = spark.sparkContext.broadcast(np.unique(term.view(np.uint64)))

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms, counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.int64)
                mine = np.isin(terms, vocabulary.value)
                yield pa.RecordBatch.from_arrays([pa.array(terms[mine].view(np.int64)), pa.array(counts[mine])], names=["term", "n"])

    df = index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(df.column(0).to_numpy().view(np.uint64).tolist(), df.column(1).to_pylist(), strict=True))
    terms = term.view(np.uint64)
    ids, first = np.unique(item, return_index=True)
    shared = spark.sparkContext.broadcast((ids, np.append(first, len(item)), terms, weights_of(n_docs, df, terms, times)))

    def search(batches):
        import pyarrow as pa

        ids, edges, terms, weights = shared.value
        tops = [Top(k) for _ in ids]
        for batch in batches:
            for i in range(len(batch)):
                shard = Shard({n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}, n_docs, n_terms, block)
                for top, a, b in zip(tops, edges[:-1], edges[1:], strict=True):
                    search_shard(shard, terms[a:b], weights[a:b], top, window)
        sizes = [len(t.ids) for t in tops]
        gather = lambda name, kind: np.concatenate([np.zeros(0, kind), *(getattr(t, name) for t in tops)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(gather("ids", np.int64), mask=~gather("known", bool)), pa.array(gather("scores", np.int64))], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(search, "item_id long, doc_id long, score long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked_search(docs.select("doc_id", "text"), items.select("item_id", "text"))
