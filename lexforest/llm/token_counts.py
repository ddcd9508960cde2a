"""Operator 10: token counts by a unigram model, scored along a trie of pre-tokens.

Every pre-token (a run of anything but ASCII white space) is cut into pieces of
a vocabulary so that the summed log-probability is largest. A prefix's forward
score does not depend on what follows it, so the distinct pre-tokens of a batch
are walked as a trie, depth first in sorted order: the scores along the shared
prefix stay on a stack and each trie node is scored once. The count at a
terminal node is stored for the pre-token and summed per document.

Documents never move: one narrow pass, no shuffle, and memory bounded by the
slice and by the memo's limit.

Edge cases: null and empty texts count 0 words and 0 tokens; characters that the
vocabulary lacks fall back to one token a UTF-8 byte; ties take fewer tokens;
repeated rows each keep their own row; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from .common import as_documents, slices, table

SCHEMA = "doc_id long, n_words long, n_bytes long, n_tokens long"
#: Pre-tokens that a worker remembers before it starts anew; a bound on memory, not on input.
MEMO = 300_000
#: A byte-fallback token costs this much more than the rarest piece.
BYTE_PENALTY = 10.0

_models: dict[str, "Unigram"] = {}


class Unigram:
    """Piece log-probabilities: Zipf's law over the vocabulary's own order of pieces."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.memo: dict[bytes, int] = {}

    @classmethod
    def load(cls, path: str) -> "Unigram":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        return cls({p: -math.log(r + 1) - norm for r, p in enumerate(pieces)})

    def count(self, words: list[str]) -> list[int]:
        """Tokens of each of the sorted words; what two neighbours share is scored once."""
        scores, longest, byte = self.scores, self.longest, self.byte
        get = scores.get
        best, used = [0.0], [0]  # along the path from the root of the trie
        last, out = "", []
        for word in words:
            n, same = min(len(word), len(last)), 0
            while same < n and word[same] == last[same]:
                same += 1
            del best[same + 1 :], used[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                width = len(word[end - 1].encode("utf-8", "surrogatepass"))
                top, top_used = best[end - 1] + byte * width, used[end - 1] + width
                for start in range(max(0, end - longest), end):
                    s = get(word[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or (s == top and used[start] + 1 < top_used):
                            top, top_used = s, used[start] + 1
                best.append(top)
                used.append(top_used)
            last = word
            out.append(used[len(word)])
        return out

    def count_bytes(self, words: set[bytes]) -> None:
        """Adds the words to the memo. A pre-token starts with the mark of a word start, as in the vocabulary."""
        new = sorted("▁" + w.decode() for w in words)
        self.memo.update((w[1:].encode(), n) for w, n in zip(new, self.count(new), strict=True))


def _count(path: str):
    def run(batches):
        import pyarrow as pa

        if path not in _models:
            _models[path] = Unigram.load(path)
        model = _models[path]
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for a, b in slices(text):
                raw = [(x or "").encode() for x in text.slice(a, b - a).to_pylist()]
                words = [x.split() for x in raw]
                if len(model.memo) > MEMO:
                    model.memo = {}
                fresh = set().union(*words) - model.memo.keys() if words else set()
                model.count_bytes(fresh)
                get = model.memo.__getitem__
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(w) for w in words], pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([sum(map(get, w)) for w in words], pa.int64())],
                    names=["doc_id", "n_words", "n_bytes", "n_tokens"],
                )

    return run


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_words, n_bytes and n_tokens of every document. model_file: a sentencepiece vocabulary that every executor can open."""
    return as_documents(docs).mapInArrow(_count(model_file), SCHEMA)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
