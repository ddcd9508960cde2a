"""Operator 3: order-preserving packing by dynamic programming.

Documents are read as one stream of token ids, each document closed by an end
id, and the stream is cut into windows of at most W ids. Windows may end at
document ends (free), sentence ends (a small penalty) and, so that no stretch
lacks a place to cut, at places inside long sentences (a larger penalty). The
cuts minimise

    sum over windows of padding(length) + penalty(cut)

where padding is W - length, and 0 if the length is a power of two. For the
linear part the best predecessor of a cut is the least dp[i] + pos[i] over a
sliding range of positions, kept by a monotone queue; the powers of two are a
dozen direct transitions.

The work is one narrow pass. Order is the input's order within each partition;
text never moves, and a segment of the stream is solved as soon as it is full,
so memory is bounded whatever the partition's size. The last W ids of a
partition may be cut anywhere, which lets the remainder split into powers of two.

Edge cases: null and empty texts are one end id; a document longer than W is
cut; repeated rows are packed once each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import as_documents, slices, table

WINDOW = 4096
END_ID = 2
#: Penalties in tokens of padding.
SENTENCE_PENALTY, HARD_PENALTY = 4, 24
#: Places for a hard cut lie this far apart in a stretch without sentence ends.
HARD_STEP = 64
#: Ids that are solved together.
SEGMENT = 1 << 20
#: Distinct chunks that a worker remembers before it starts anew; a bound on memory, not on input.
MEMO = 700_000
#: Bytes of text that are cut into chunks together; each chunk is a Python string, some ten times its share of the text.
SLICE = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_ODD = re.compile("[^\x00-\u012f\u0131-\u017f]")

_encoders: dict[str, "Encoder"] = {}


def plain(text: str) -> bool:
    """Whether lower case is the same with and without context, and no special token's string can start."""
    return not ("<|" in text or (not text.isascii() and _ODD.search(text)))


class Encoder:
    """Ids of whole texts, from remembered ids of chunks.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its chunks between blanks and line feeds, in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            if piece.endswith("</w>") and piece[:-4] and set(piece[:-4]) <= set(".!?"):
                self.ends[i] = True
        self.model = self.tokenizer.model
        # bytes as the tokenizer's alphabet writes them: printable ones as themselves, the others from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = dict(zip([b for b in range(256) if b not in printable], range(256, 512), strict=False))
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self._add(["", " end"], [[], [END_ID]])

    def _add(self, chunks: list[str], ids: list[list[int]]) -> None:
        at = len(self.index)
        self.index.update(zip(chunks, range(at, at + len(chunks)), strict=True))
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum()))])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lens)])

    def _ids(self, chunk: str) -> list[int]:
        i = self.index[chunk]
        return self.flat[self.first[i] : self.first[i + 1]].tolist()

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        """A run of lower-case letters is one pre-token, which the model takes as it is, byte by byte in its alphabet."""
        out: list = [None] * len(chunks)
        rest = []
        for k, c in enumerate(chunks):
            if c.isalpha() and c.lower() == c and plain(c):
                out[k] = [t.id for t in self.model.tokenize(c if c.isascii() else c.encode().decode("latin-1").translate(self.alphabet))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch([chunks[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _learn(self, fresh: set[str]) -> None:
        """Letters and one mark after them are two pre-tokens."""
        two = [c for c in fresh if len(c) > 1 and c[-1] in ".,!?;:" and c[:-1].isalpha() and plain(c)]
        one = list((fresh.difference(two) | {c[:-1] for c in two} | {c[-1] for c in two}) - self.index.keys())
        self._add(one, self._encode(one))
        self._add(two, [self._ids(c[:-1]) + self._ids(c[-1]) for c in two])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by END_ID, and each text's number of ids."""
        chunks: list[str] = []
        counts = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = (text.lower() if plain(text) else text).replace("\n", " ").split(" ")
            counts[k] = len(own) + 1
            chunks += own
            chunks.append(" end")
        if len(self.index) > MEMO:
            self.reset()
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = [chunks[i] for i in new.tolist()]
            self._learn(set(missing))
            at[new] = np.fromiter(map(self.index.__getitem__, missing), np.int64, len(missing))
        first, lens = self.first[at], self.first[at + 1] - self.first[at]
        total = np.concatenate([[0], np.cumsum(lens)])
        flat = self.flat[np.repeat(first - total[:-1], lens) + np.arange(total[-1])]
        ends = total[np.cumsum(counts)] if len(texts) else np.zeros(0, np.int64)
        return flat, np.diff(ends, prepend=0)


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, window: int, free_tail: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending and ending with the stream, and their penalties."""
    n = len(ids)
    penalty = np.full(n + 1, -1, np.int32)
    penalty[np.flatnonzero(sentence_end[ids]) + 1] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    known = np.flatnonzero(penalty >= 0)
    known = np.concatenate([[0], known[known > 0]])
    gaps = np.diff(known)
    for k in np.flatnonzero(gaps > HARD_STEP).tolist():
        penalty[known[k] + HARD_STEP : known[k + 1] : HARD_STEP] = HARD_PENALTY
    if free_tail:
        tail = penalty[max(1, n - window) :]
        tail[tail < 0] = HARD_PENALTY
    penalty[n], penalty[0] = 0, -1
    pos = np.flatnonzero(penalty >= 0)
    return pos, penalty[pos]


def best_cuts(pos: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> tuple[list[int], list[int], list[int]]:
    """(cost, predecessor, position) of each place, place 0 being the stream's start."""
    n = len(pos) + 1
    at = np.concatenate([[0], pos]).astype(np.int64)
    # direct transitions of a power of two between places
    direct: list = [()] * n
    where = np.full(int(at[-1]) + 1, -1, np.int64)
    where[at] = np.arange(n)
    p = 1
    while p <= window:
        far = at - p
        ok = np.flatnonzero(far >= 0)
        ok = ok[where[far[ok]] >= 0]
        for j, i in zip(ok.tolist(), where[far[ok]].tolist(), strict=True):
            direct[j] = (*direct[j], i)
        p *= 2
    places, cost_of = at.tolist(), [0, *penalty.tolist()]
    dp, back = [0] * n, [-1] * n
    queue: deque[int] = deque([0])
    key = [0] * n  # dp[i] + position
    for j in range(1, n):
        here = places[j]
        while places[queue[0]] < here - window:
            queue.popleft()
        i = queue[0]
        best = key[i] + window - here
        for d in direct[j]:
            if dp[d] < best:
                best, i = dp[d], d
        dp[j], back[j] = best + cost_of[j], i
        k = key[j] = dp[j] + here
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    return dp, back, places


class Stream:
    """Documents of a partition, packed segment by segment."""

    def __init__(self, sentence_end: np.ndarray, base: int, window: int):
        self.sentence_end, self.window, self.next = sentence_end, window, base
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []  # doc_id, its ids before, its ids from there on
        self.size = 0

    def add(self, ids: np.ndarray, docs: list[tuple[int, int]]) -> None:
        self.ids.append(ids)
        self.docs += [(d, 0, n) for d, n in docs]
        self.size += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        """Pieces of what can be settled; the rest stays."""
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        if not len(ids):
            return []
        ends = np.cumsum([n for _, _, n in self.docs])
        pos, penalty = cut_places(ids, ends, self.sentence_end, self.window, last)
        dp, back, places = best_cuts(pos, penalty, self.window)
        j = len(places) - 1
        if not last:  # the cheapest place in the last window; what follows waits for more
            first = np.searchsorted(places, len(ids) - self.window)
            j = max(1, int(first) + int(np.argmin(dp[int(first) :])))
        cuts = [places[j]]
        while j:
            j = back[j]
            cuts.append(places[j])
        cuts.reverse()
        rows, k, starts = [], 0, (ends - [n for _, _, n in self.docs]).tolist()
        ends = ends.tolist()
        for first, b in zip(cuts[:-1], cuts[1:], strict=True):
            a = first
            while a < b:
                doc, before, n = self.docs[k]
                upto = min(b, ends[k])
                begin = before + a - starts[k]
                rows.append((doc, begin, upto - a, zlib.crc32(ids[a:upto].astype("<u4").tobytes()), before + n, self.next, a - first))
                a = upto
                if upto == ends[k]:
                    k += 1
            self.next += 1
        done = cuts[-1]
        self.ids, self.size = [ids[done:].copy()], len(ids) - done
        rest = self.docs[k:]
        if rest and done > starts[k]:
            doc, before, n = rest[0]
            rest[0] = (doc, before + done - starts[k], n - (done - starts[k]))
        self.docs = rest
        return rows


def _pack(path: str, window: int, segment: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        stream = Stream(encoder.ends, TaskContext.get().partitionId() << 32, window)

        def out(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for a, b in slices(text, SLICE):
                flat, counts = encoder.encode([x or "" for x in text.slice(a, b - a).to_pylist()])
                stream.add(flat, list(zip(ids.slice(a, b - a).to_pylist(), counts.tolist(), strict=True)))
                if stream.size >= segment:
                    yield out(stream.pack(False))
        yield out(stream.pack(True))

    return run


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """One row a piece: which ids of which document stand where in which sequence."""
    return as_documents(docs).mapInArrow(_pack(tokenizer_file, window, segment), SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
