"""Operator 8: removal of long repeated byte strings by suffix arrays of shards.

A byte goes if a string of LENGTH bytes that covers it also starts somewhere else
(in any document, matches never crossing documents). Two equal strings of that
length choose the same minimiser: the first GRAM bytes of least hash among those inside.
So the strings around one minimiser hash meet in one shard, and no match is
compared across shards:

1. every document gives its minimisers (hash, place) and, of each, the stretch of
   bytes in which the strings that choose it lie (its reach), with a checksum, in
   one pass; a string is in one reach only;
2. hashes that occur once are dropped by a partial aggregate; a reach that occurs
   twice is repeated throughout; only hashes with several distinct reaches go on;
3. one copy of each such reach is brought to the shard of its hash. The shard's
   suffix array is built by induced sorting, and the permuted common prefixes tell
   which strings of LENGTH bytes start more than once;
4. the repeated stretches go back to all places with that reach, and each document
   is cut once.

Copies are counted, not shipped, so a passage that a third of all documents hold
is one reach. A hash whose distinct reaches have more than SHARD_BYTES is cut up:
the strings that start in one BLOCK of places before the gram share almost all their bytes, and
these join the hash as the key of the next level, down to single strings, which are
only counted. So a shard holds some SHARD_BYTES, however often a gram occurs.

Edge cases: null text is empty; shorter texts than LENGTH stay; rows that share a
doc_id are separate documents; an empty table gives no rows; other columns are
ignored. A whole text's minimisers are found at once by one task (some tens of
bytes of memory a byte of text).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, numbered, slices, stream64, string_bytes, table
from .induced import common_with_previous, suffix_array

LENGTH, GRAM = 200, 64
SHARD_BYTES = 2 << 20
#: Starting places that share a key at each level; the first has all of a minimiser.
BLOCKS = (LENGTH, 16, 1)

_CODE = stream64(256, 81) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over every window of width."""
    n = 1
    while n * 2 <= width:
        a = f(a[:-n], a[n:])
        n *= 2
    return f(a[: len(a) - (width - n)], a[width - n :]) if n < width else a


def minimisers(b: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the first least of some string of length bytes, and the first and last start of those strings."""
    h, n, p = _CODE[b], 1, _BASE
    with np.errstate(over="ignore"):
        while n < gram:
            h = h[:-n] * p + h[n:]
            p, n = p * p, n * 2
    h = mix64(h)
    width = length - gram + 1
    least = _slide(h, width, np.minimum)
    # the choice changes where another gram is least or the last choice stood at the start
    fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])])
    start = np.flatnonzero(fresh)
    stop = np.append(start[1:], len(least)) - 1
    # the first place from the start on with that hash, among the places of any hash that is chosen
    values, rank = np.unique(least[start], return_inverse=True)
    pad = np.zeros(width - 1, np.uint64)
    some = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    at = np.searchsorted(values, h[some])
    keys = np.sort(at * np.int64(len(b) + 1) + some)
    place = keys[np.searchsorted(keys, rank * np.int64(len(b) + 1) + start)] % (len(b) + 1)
    return place, least[start], start, stop


class Checksums:
    """Polynomial checksums of any stretch of bytes, from running sums."""

    def __init__(self, b: np.ndarray):
        power = np.cumprod(np.full(len(b) + 1, _BASE, np.uint64))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[b] * power[:-1])])
        self.back = np.cumprod(np.full(len(b) + 1, _INVERSE, np.uint64))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        # brought to one exponent by the inverse powers
        return (self.total[last] - self.total[first]) * self.back[first]


def reach_of(sums: Checksums, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix64(sums.of(first, last) + ((place - first) * 1024 + last - place).astype(np.uint64))


ANCHOR = "__row long, place int, hash long, left int, right int, reach long"


def _anchor_batch(out: list[tuple]):
    import pyarrow as pa

    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    names = [x.split()[0] for x in ANCHOR.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(t.to_pandas_dtype()), t) for c, t in zip(cols, kinds, strict=True)], names=names)


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """__row, place, hash, and left and right (bytes of the reach before and from the place) and reach (their checksum) of every minimiser."""

    def run(batches):
        for batch in batches:
            for a, z in slices(batch.column(1)):
                buf, off = string_bytes(batch.column(1).slice(a, z - a))
                rows = batch.column(0).slice(a, z - a).to_numpy()
                out = []
                for k in np.flatnonzero(np.diff(off) >= length).tolist():
                    b = buf[off[k] : off[k + 1]]
                    place, h, first, last = minimisers(b, gram, length)
                    last = last + length
                    reach = reach_of(Checksums(b), place, first, last)
                    out.append((np.full(len(place), rows[k]), place, h, place - first, last - place, reach))
                if out:
                    yield _anchor_batch(out)

    return docs.select("__row", "text").mapInArrow(run, ANCHOR)


def finer_anchors(docs: DataFrame, found: DataFrame, length: int, block: int) -> DataFrame:
    """The anchors in found (__row, place, hash, left, right) once for each block of starts, with what its strings share in the hash."""
    per = found.groupBy("__row").agg(F.collect_list(F.struct("place", "hash", "left", "right")).alias("cuts"))

    def run(batches):
        for batch in batches:
            out = []
            for row, text, cuts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                sums = Checksums(np.frombuffer(text.encode(), np.uint8))
                place, h, left, right = (np.array([c[x] for c in cuts], np.int64) for x in ("place", "hash", "left", "right"))
                # starts lie back = place - start before the gram
                least = left + right - length
                least = left - least
                n = left // block - least // block + 1
                k = np.repeat(np.arange(len(place)), n)
                number = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + least[k] // block
                far, near = np.minimum(left[k], number * block + block - 1), np.maximum(least[k], number * block)
                p = place[k]
                core = sums.of(p - number * block, p - number * block - block + 1 + length)
                key = mix64(h[k].view(np.uint64) ^ mix64(core + number.astype(np.uint64)))
                first, last = p - far, p - near + length
                out.append((np.full(len(p), row), p, key, p - first, last - p, reach_of(sums, p, first, last)))
            if out:
                yield _anchor_batch(out)

    return docs.select("__row", "text").join(per, "__row").mapInArrow(run, ANCHOR)


def solve_shard(rows: np.ndarray, begins: np.ndarray, texts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(index, from, to): stretches of the texts whose strings of length bytes start at two places or more.

    rows, begins: the document and place of each text; texts of one document may overlap, so
    a string counts by where it stands.
    """
    sizes = np.array([len(x) for x in texts])
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    text = np.ones(int(sizes.sum()) + len(texts), np.int64)  # 1 ends a text
    for a, x in zip(first.tolist(), texts, strict=True):
        text[a : a + len(x)] = np.frombuffer(x, np.uint8).astype(np.int64) + 2
    sa = suffix_array(text)
    shared = common_with_previous(text, sa, length)[sa]
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = np.arange(len(text)) - first[owner]
    full = sizes[owner] - inside >= length
    _, doc = np.unique(rows, return_inverse=True)
    stands = (doc[owner].astype(np.int64) << 32) + begins[owner] + inside
    # runs of the array that share a string, and whether they stand at different places
    run = np.cumsum(shared < length) - (1 if len(shared) and shared[0] < length else 0)
    keep = full[sa]
    order, run = sa[keep], run[keep]
    starts = np.zeros(len(text), bool)
    if len(order):
        edge = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1])
        several = np.minimum.reduceat(stands[order], edge) != np.maximum.reduceat(stands[order], edge)
        starts[order] = np.repeat(several, np.diff(np.append(edge, len(order))))
    out = []
    at = np.flatnonzero(starts)
    if len(at):
        cut = np.flatnonzero((np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]]))
        for i, j in zip(np.concatenate([[0], cut + 1]).tolist(), np.concatenate([cut, [len(at) - 1]]).tolist(), strict=True):
            k = int(owner[at[i]])
            out.append((k, int(inside[at[i]]), int(inside[at[j]]) + length))
    return out


def solved(docs: DataFrame, wanted: DataFrame, shards: int, length: int) -> DataFrame:
    """hash, reach, begin and end (from the place) of the repeated stretches of the reaches in wanted (__row, hash, reach, a, size, left)."""
    wanted = wanted.groupBy("__row").agg(F.collect_list(F.struct("hash", "reach", "a", "size", "left")).alias("cuts"))
    pieces = docs.select("__row", F.encode("text", "utf-8").alias("bytes")).join(wanted, "__row").select("bytes", F.explode("cuts").alias("c"), "__row")
    pieces = pieces.select("c.hash", "c.reach", "c.left", "__row", "c.a", F.substring("bytes", F.col("c.a") + 1, F.col("c.size")).alias("piece"))

    def solve(table):
        import pyarrow as pa

        h, r, left = (table.column(c).to_numpy() for c in ("hash", "reach", "left"))
        found = solve_shard(table.column("__row").to_numpy(), table.column("a").to_numpy(), [x.as_py() for x in table.column("piece")], length)
        k = np.array([x[0] for x in found], np.int64)
        return pa.table({
            "hash": pa.array(h[k], pa.int64()), "reach": pa.array(r[k], pa.int64()),
            "begin": pa.array([x[1] - int(left[x[0]]) for x in found], pa.int32()), "end": pa.array([x[2] - int(left[x[0]]) for x in found], pa.int32()),
        })

    part = pieces.withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards)))
    return part.groupBy("shard").applyInArrow(solve, "hash long, reach long, begin int, end int")


def stretches(scratch: Scratch, docs: DataFrame, length: int, gram: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """__row, begin and end of repeated stretches of bytes; they may overlap."""
    every, parts = scratch.save(anchors(docs, length, gram)), []
    for finer in (*BLOCKS[1:], None):
        per = every.groupBy("hash").agg(F.count("*").alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high")).where("n > 1")
        per = scratch.save(per.select("hash", (F.col("low") != F.col("high")).alias("mixed")))
        known = scratch.save(every.join(per, "hash"))
        scratch.drop(every)
        # equal reaches of a hash have the same bytes to the left and right
        one = known.groupBy("hash", "reach").agg(F.count("*").alias("n"), F.max("mixed").alias("mixed"), F.max("left").alias("left"), F.max("right").alias("right"), F.min(F.struct("__row", "place")).alias("at"))
        one = scratch.save(one)
        whole = one.where("n > 1").select("hash", "reach", (-F.col("left")).alias("begin"), F.col("right").alias("end"))
        # a copy of each reach of the mixed hashes; those that are repeated anyway still count as partners
        mixed = one.where("mixed").select("hash", "reach", "left", "right", F.col("at.__row").alias("__row"), F.col("at.place").alias("place"))
        sizes = scratch.save(mixed.groupBy("hash").agg(F.sum(F.col("left") + F.col("right")).alias("bytes")))
        hot = F.lit(finer is not None) & (F.col("bytes") > shard_bytes)
        total, n_hot = sizes.agg(F.coalesce(F.sum(F.when(~hot, F.col("bytes"))), F.lit(0)), F.count_if(hot)).first()
        wanted = mixed.join(sizes.where(~hot), "hash").select("__row", "hash", "reach", (F.col("place") - F.col("left")).alias("a"), (F.col("left") + F.col("right")).alias("size"), "left")
        repeated = scratch.save(whole.unionByName(solved(docs, wanted, max(1, total // shard_bytes), length)))
        parts.append(known.join(repeated, ["hash", "reach"]).select("__row", (F.col("place") + F.col("begin")).alias("begin"), (F.col("place") + F.col("end")).alias("end")))
        if not n_hot:
            break
        every = scratch.save(finer_anchors(docs, mixed.join(sizes.where(hot), "hash"), length, finer))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 of every document.

    docs is read from files, so that a row has the same number at each reading.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = numbered(scratch, docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")))
    spans = scratch.save(stretches(scratch, docs, length, gram, shard_bytes).groupBy("__row").agg(F.collect_set(F.struct("begin", "end")).alias("spans")))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                edge = np.zeros(len(raw) + 1, np.int64)
                for s in found or ():
                    edge[max(0, s["begin"])] += 1
                    edge[min(len(raw), s["end"])] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                n = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
                rows.append((doc, len(raw), len(raw) - len(kept), n, kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    both = docs.join(spans, "__row", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).drop("kept")
