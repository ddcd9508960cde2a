"""Texts of one Arrow batch are cut into chunks a little at a time."""

import pyarrow as pa
import pyspark
import public_tokenizers

from lexforest.llm import packing


class Task:
    get = staticmethod(lambda: Task)
    partitionId = staticmethod(lambda: 0)


def test_a_large_batch_is_encoded_in_slices(monkeypatch):
    monkeypatch.setattr(pyspark, "TaskContext", Task)
    seen, encode = [], packing.Encoder.encode
    monkeypatch.setattr(packing.Encoder, "encode", lambda self, texts: (seen.append(sum(map(len, texts))), encode(self, texts))[1])
    texts = ["some words of a text. " * 500] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(packing._pack(public_tokenizers.path("word_bpe_49k.json"), 4096, 1 << 20)([batch]))
    assert sum(seen) == 300 * 11000 and max(seen) <= 1 << 20
    pieces = [r for b in out for r in b.to_pylist()]
    total = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert sum(r["length"] for r in pieces) == sum(total.values()) and len(total) == 300
