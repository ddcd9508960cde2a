"""Each operator against a brute-force version, with nulls, empties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from lexforest.llm import exact_topk, line_dedup, mixing, near_dup, packing, permutation, quality, repeats, sharding, token_counts, vectors
from lexforest.llm.common import Scratch, numbered
from lexforest.llm.components import components
from lexforest.llm.edits import within
from lexforest.llm.induced import common_with_previous, suffix_array
from lexforest.llm.queries import queries as registered
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 6 != 5), 0) for i in range(60)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    voter = quality.fit(docs, labels, folds=5)
    out = quality.score(docs, voter, keep=["doc_id", "text"]).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id < 60 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 5 and all(r.predicted == int(r.doc_id % 6 != 5) for r in held)
    mean = float(voter.labels.mean())
    assert all(abs(r.score - mean) < 1e-6 for r in out if not (r.text or "").strip())
    assert quality.score(none, voter, keep=["doc_id"]).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0)), keep=["doc_id"]).collect()} == {0.5}


def test_quality_votes(spark, docs):
    """Scores against a vote with loops: pair counts, the projection, all cosines sorted."""
    labels = spark.createDataFrame([(i, int(i % 6 != 5), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    voter = quality.fit(docs, labels, folds=5)
    got = defaultdict(list)
    for r in quality.score(docs, voter, keep=["doc_id"]).collect():
        got[r.doc_id].append(r.score)
    for i, t in texts(docs):
        raw = (t or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        if not words:
            continue
        chars, buckets = [0.0] * quality.CLASSES**2, [0.0] * quality.WORD_BUCKETS
        for a, b in zip(raw, raw[1:]):
            chars[int(quality._CLASS[a]) * quality.CLASSES + int(quality._CLASS[b])] += 1
        h = quality.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[3]
        for x in h.tolist():
            buckets[x % quality.WORD_BUCKETS] += 1
        again = sum(a == b for a, b in zip(words, words[1:]))
        x = [math.sqrt(v / max(sum(block), 1)) * w for block, w in zip((chars, buckets, [again, len(words) - again]), quality.BLOCK_WEIGHTS) for v in block]
        z = (np.array(x) - voter.mean) @ voter.basis
        z /= np.linalg.norm(z)
        near = sorted(((float(z @ v), y) for v, y in zip(voter.vectors.astype(float), voter.labels.tolist())), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 0) ** 4, y) for c, y in near]
        lean = quality.LEAN / len(words)
        want = (sum(w * y for w, y in votes) + lean * float(voter.labels.mean())) / (sum(w for w, _ in votes) + lean)
        assert any(abs(s - want) < 2e-3 for s in got[i]), (i, want, got[i])


def test_sharding(spark, docs, none):
    rows = sharding.shard(docs, 7).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(v) for v in by.values()]
    assert len(rows) == docs.count() and max(sizes) - min(sizes) <= 1 and set(by) == set(range(7))
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts(docs))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert max(r.curve for r in by[0]) <= min(r.curve for r in by[6])
    assert sharding.shard(none, 7).count() == 0
    assert sorted(r.shard for r in sharding.shard(docs.limit(3), 7).collect()) == [0, 1, 2]


def test_hilbert_visits_neighbours(spark):
    points = spark.range(512).select(*(F.shiftright("id", k).bitwiseAND(F.lit(7)).cast("int").alias(f"x{i}") for i, k in enumerate((6, 3, 0))))
    rows = points.withColumn("h", sharding.hilbert([F.col("x0"), F.col("x1"), F.col("x2")], 3)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(512))
    assert all(sum(abs(a[i] - b[i]) for i in range(3)) == 1 for a, b in zip(rows[:-1], rows[1:], strict=True))


def test_packing_round_trip(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = packing.Encoder(path).tokenizer
    rows = packing.pack(docs, path, window=256, segment=2000).collect()
    assert packing.pack(none, path).count() == 0
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    seen = Counter(i for i, _ in texts(docs))
    for i, t in set(texts(docs)):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        if seen[i] == 1:
            at = 0
            for p in pieces:
                assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in pieces) == seen[i] * len(ids)
    pad = total = 0
    for v in by_seq.values():
        at = 0
        for p in sorted(v, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
        total, pad = total + at, pad + (0 if at & (at - 1) == 0 else 256 - at)
    assert pad < 0.06 * total


def test_best_cuts_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(2, 25))
        pos = np.cumsum(rng.integers(1, 9, n))
        pen = rng.integers(0, 6, n)
        dp, _, places = packing.best_cuts(pos, pen, 16)
        best = [0] + [10**9] * n
        for j in range(1, n + 1):
            for i in range(j):
                size = places[j] - places[i]
                if size <= 16:
                    best[j] = min(best[j], best[i] + (0 if size & (size - 1) == 0 else 16 - size) + int(pen[j - 1]))
        assert dp == best


def test_odd_texts_encode_exactly():
    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["It's. They'LL, 'S", "<|endoftext|> a.b, <|x", "ÉÉ İx Σς ß²½ _.", "a..  b., c\x85\x1cd", "́e é", "你好 mundo.", ""]
    flat, counts = e.encode(odd)
    at = 0
    for t, n in zip(odd, counts.tolist(), strict=True):
        assert flat[at : at + n].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [2]
        at += n


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark, none):
    base = "the quick brown fox jumps over the lazy dog and naps"
    rows = [(1, base + "\nshort\n" + base), (2, base.replace("fox", "fix") + "\nshort\nunique line of this document, long enough to count"), (3, base.replace("quick", "quack").replace("dog", "dig") + "\n\n" + base + "!"),
            (4, None), (5, ""), (6, "entirely different words stand in this line, é and ß too"), (7, "entirely different words stand in this line, e and ß toe"), (8, base.replace("naps", "sings loud")), (6, "entirely different words stand in this line, é and ß too")]
    df = numbered(Scratch(spark, "test"), spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    got = [(r.doc_id, list(r.dropped)) for r in line_dedup.line_dedup(df).orderBy("__row").collect()]
    first = {}
    for k, (i, t) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line, (i, k, p))
    near = {a for a in first for b in first if len(a) >= 40 and len(b) >= 40 and first[b] < first[a] and distance(a, b) <= 2}
    want = [(i, [p for p, x in enumerate((t or "").split("\n")) if x in first and (first[x] != (i, k, p) or x in near)]) for k, (i, t) in enumerate(rows)]
    assert got == want and any(d for _, d in want)
    assert line_dedup.line_dedup(numbered(Scratch(spark, "test"), none)).count() == 0


def test_line_dedup_of_short_lines(spark):
    rng = random.Random(4)
    lines = []
    for n in [*range(1, 14), *range(17, 25), *range(36, 44)] * 3:
        base = "".join(rng.choice("abcdeé ") for _ in range(n)) + "."
        lines.append(base)
        for _ in range(4):
            x = list(base)
            for _ in range(rng.randint(1, 3)):
                at, kind = rng.randrange(len(x) or 1), rng.randrange(3)
                x[at : at + (kind != 0)] = [rng.choice("abcdeé ")] if kind < 2 else []
            lines.append("".join(x))
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, "\n".join(lines[i::40])) for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: list(r.dropped) for r in line_dedup.line_dedup(numbered(Scratch(spark, "test"), docs)).collect()}
    placed = [(x, i, p) for i in range(40) for p, x in enumerate(lines[i::40])]
    want, earlier = {i: [] for i in range(40)}, []
    for x, i, p in placed:
        if x.strip() and x in earlier or len(x) >= 10 and any(len(y) >= 10 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in earlier):
            want[i].append(p)
        earlier.append(x)
    assert got == want and sum(map(len, want.values())) > 50


def test_line_dedup_cuts_up_large_keys(spark, monkeypatch):
    """Many lines with one start, of which few are near another; keys are cut up from a few lines on."""
    monkeypatch.setattr(line_dedup, "PER_KEY", 0.1)
    rng = random.Random(7)
    start = "all of these lines begin with the very same words, and then "
    lines = [start + "".join(rng.choice("abcdefghij") for _ in range(30)) for _ in range(150)]
    for _ in range(60):
        x = list(rng.choice(lines))
        for at in rng.sample(range(len(x)), rng.randint(1, 3)):
            x[at] = "#"
        lines.append("".join(x)[rng.randint(0, 1) :])
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, "\n".join(lines[i::20]), 1, "x", 2) for i in range(20)], "doc_id long, text string, place int, line string, key int")
    got = {r.doc_id: list(r.dropped) for r in line_dedup.line_dedup(numbered(Scratch(spark, "test"), docs)).collect()}
    want, earlier = {i: [] for i in range(20)}, []
    for i in range(20):
        for p, x in enumerate(lines[i::20]):
            if any(abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in earlier):
                want[i].append(p)
            earlier.append(x)
    assert got == want and sum(map(len, want.values())) > 20


@pytest.mark.parametrize("frame", ["Subscriber reference {} was recorded by the office of {} on request"])
def test_line_dedup_of_boilerplate(spark, frame, monkeypatch):
    """Large keys whose lines differ in a few places only: keys of deletions, of more segments and of halves against brute force."""
    monkeypatch.setattr(line_dedup, "FEW", 4)
    monkeypatch.setattr(line_dedup, "PER_KEY", 0.02)
    monkeypatch.setattr(line_dedup, "WIDTH", 12)
    rng = random.Random(len(frame))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    lines = [frame.format(digits(8), rng.choice(["", digits(2), digits(14), digits(30)])) for _ in range(90)]
    for _ in range(60):
        x = list(rng.choice(lines))
        for _ in range(rng.randint(1, 3)):
            at, kind = rng.randrange(len(x)), rng.randrange(3)
            x[at : at + (kind != 0)] = [rng.choice("0123456789")] if kind < 2 else []
        lines.append("".join(x))
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, "\n".join(lines[i::20])) for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: list(r.dropped) for r in line_dedup.line_dedup(numbered(Scratch(spark, "test"), docs)).collect()}
    want, earlier = {i: [] for i in range(20)}, []
    for i in range(20):
        for p, x in enumerate(lines[i::20]):
            if any(abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in earlier):
                want[i].append(p)
            earlier.append(x)
    assert got == want and sum(map(len, want.values())) > 20


def test_edit_distance(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        a = [rng.choice("ab\U0001f600é\n") for _ in range(rng.randint(0, 24))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at, kind = rng.randint(0, len(b)), rng.randrange(3)
            b[at : at + (kind != 0)] = [rng.choice("ab\U0001f600é")] if kind < 2 else []
        rows.append((i, "".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    flags = df.select(*(F.struct(within(F.col("a"), F.col("b"), e).alias("got"), (F.levenshtein("a", "b") <= e).alias("want")).alias(f"e{e}") for e in (0, 1, 2, 3))).collect()
    assert all(x.got == x.want for r in flags for x in r)


def test_row_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 20) AS text").repartition(3).write.option("parquet.block.size", "65536").parquet(str(tmp_path / "t"))
    seen = []
    for size in ("64m", "100k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append({r.doc_id: r["__row"] for r in numbered(Scratch(spark, "test"), spark.read.parquet(str(tmp_path / "t"))).select("doc_id", "__row").collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 20_000


def rows_of(spark, df):
    return numbered(Scratch(spark, "test"), df)


@pytest.mark.parametrize("name", ["op2_sharding", "op5_mixing"])
def test_registered_queries_do_not_depend_on_the_splits(spark, docs, tmp_path, name):
    """Texts and ids that repeat, in files of many row groups."""
    copies = docs.unionByName(docs.where("doc_id < 20")).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nx"), "doc_id")).otherwise(F.col("text")))
    copies.repartition(3).write.option("parquet.block.size", "4096").option("parquet.page.size", "1024").parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for size in ("64m", "64k", "9k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append(Counter(str(r) for r in registered()[name](spark, str(tmp_path)).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(x == seen[0] for x in seen)


def test_mixing(spark, docs, none):
    documents, schedule = mixing.mix(rows_of(spark, docs))
    size = {}
    total = defaultdict(int)
    for r in documents.collect():
        size[r.row_id] = (r.source, r.size, r.target)
        total[r.source] += r.size
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, full = 1.5 * sum(total.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (budget - sum(2 * total[s] for s in full)) / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    taken, per = defaultdict(int), defaultdict(int)
    for r in schedule.collect():
        taken[size[r.row_id][0]] += r.words
        per[r.row_id] += r.words
    for s in names:
        target = 2 * total[s] if s in full else level * weight[s]
        assert abs(target - next(t for x, _, t in size.values() if x == s)) < 1e-6 and abs(taken[s] - target) <= len(names)
    assert all(n <= 2 * size[k][1] for k, n in per.items())
    again = {(r.row_id, r["pass"]): r.words for r in mixing.mix(rows_of(spark, docs))[1].collect()}
    assert again == {(r.row_id, r["pass"]): r.words for r in schedule.collect()}
    assert mixing.mix(rows_of(spark, none))[1].count() == 0
    clash = docs.withColumns({"__row_id": F.lit(1), "row_id": F.lit(2), "size": F.lit(3), "__row": F.lit(4)})
    assert sorted(r.words for r in mixing.mix(rows_of(spark, clash))[1].collect()) == sorted(again.values())


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16))
    x[100:400] = x[7]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(700, None), (701, [float("nan")] * 16), (702, [0.0] * 16), (750, [1.0, None] + [0.0] * 14), (800, [1.0] * 3), (850, [float("inf")] * 16)]
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int"), x


def test_exact_topk(spark, embeddings):
    df, x = embeddings
    whole = vectors.usable(df).withColumn("v", F.transform("v", lambda c: F.floor(c * 256).cast("double")))
    got = defaultdict(list)
    for r in exact_topk.exact_topk(whole, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = np.vstack([np.floor(x * 256).astype(np.int64), np.zeros((1, 16), np.int64)])
    ids = np.array([*range(700), 702])
    assert set(got) == set(range(0, 700, 50))
    for q in got:
        s = y @ y[q]
        best = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        assert got[q] == [(int(ids[k]), int(s[k])) for k in best]
    assert exact_topk.exact_topk(whole.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("chunk", [8192, 2])
def test_exact_topk_of_repeated_ids(spark, chunk, monkeypatch):
    """Each row of a repeated query has its own five."""
    monkeypatch.setattr(exact_topk, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    x, ids = np.round(rng.normal(size=(1600, 8)) * 100), np.arange(1600)
    # the query stands eight times, is the first pivot, and is far from the others
    query = spark.range(1600).orderBy(F.xxhash64(F.lit(exact_topk.SEED), "id")).first().id
    x[query] *= 5
    ids, x = np.concatenate([ids, [query] * 7]), np.concatenate([x, [x[query]] * 7])
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, v array<double>")
    asked = [query, (query + 1) % 1600]
    want = Counter()
    for i, a in zip(ids, x, strict=True):
        if i in asked:
            best = sorted((-int(s), int(j)) for j, s in zip(ids, x @ a, strict=True) if j != i)[:5]
            want.update((int(i), r + 1, j, -s) for r, (s, j) in enumerate(best))
    got = Counter(tuple(r) for r in exact_topk.exact_topk(df, F.col("vec_id").isin(asked)).collect())
    assert got == want


def test_permutation_index_of_repeated_ids(spark, monkeypatch):
    """A vec_id with many rows fills many blocks, and each row of a repeated query has its own five."""
    monkeypatch.setattr(permutation, "BLOCK", 50)
    monkeypatch.setattr(permutation, "CHUNK", 3)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(8, 6))[rng.integers(0, 8, 900)] + rng.normal(size=(900, 6)) * 0.1
    ids = np.where(np.arange(900) % 3 == 0, 0, np.arange(900))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, v array<double>")
    rows = permutation.permutation_search(df, F.col("vec_id") % 50 == 0).collect()
    asked = np.flatnonzero(ids % 50 == 0)
    assert Counter(r.query_id for r in rows) == Counter({int(i): 5 * int((ids == i).sum()) for i in set(ids[asked].tolist())})
    u, want = x / np.linalg.norm(x, axis=1, keepdims=True), Counter()
    for q in asked:
        s = np.where(ids == ids[q], -9, u @ u[q])
        want.update((int(ids[q]), int(ids[k])) for k in np.lexsort((ids, -s))[:5])
    got = Counter((r.query_id, r.vec_id) for r in rows)
    assert sum((got & want).values()) >= 0.9 * sum(want.values())


def test_clustered_vectors_need_few_cells():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 5
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.2
    assert permutation.cells_needed(x, permutation.unit(x[:128]), 5, 0.96) < 20
    assert permutation.cells_needed(x[:1], permutation.unit(x[:1]), 5, 0.96) == 1


def test_permutation_index(spark, embeddings):
    df, x = embeddings
    rows = permutation.permutation_search(vectors.usable(df, allow_zero=False), F.col("vec_id") % 50 == 0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 700, 50):
        s = u @ u[q]
        s[q] = -9
        mine = {r.vec_id: r.score for r in rows if r.query_id == q}
        assert len(mine) == 5 and all(abs(s[k] - v) < 1e-12 for k, v in mine.items())
        hits += (np.array(sorted(mine.values())) >= np.sort(s)[-5:] - 1e-12).sum()
    assert hits >= 0.9 * 5 * 14
    assert permutation.permutation_search(vectors.usable(df.limit(0)), F.lit(True)).count() == 0


def test_permutation_index_ties_to_the_smaller_id(spark, embeddings):
    df, x = embeddings
    rows = permutation.permutation_search(vectors.usable(df, allow_zero=False), F.col("vec_id") % 50 == 0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.query_id, r.vec_id) for r in rows}
    want = set()
    for q in range(0, 700, 50):
        s = (u * u[q]).sum(1)
        s[q] = -9
        want |= {(q, int(k)) for k in np.lexsort((np.arange(700), -s))[:5]}
    assert len(got & want) >= 0.9 * len(want)
    assert {p for p in got if 100 <= p[0] < 400} == {p for p in want if 100 <= p[0] < 400}


def sets_of(rows, width):
    out = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("width", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, none, width, num):
    sets = sets_of(texts(docs), width)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(numbered(Scratch(spark, "test"), docs), width, (num, 100)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert near_dup.near_duplicates(numbered(Scratch(spark, "test"), none), width).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(8)
    one, two = (" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(200)) for _ in range(2))
    rows = [(1, one), (1, two), (2, one + " word"), (3, two + " word"), (4, "apart from all others"), (None, one), (None, None)]
    df = numbered(Scratch(spark, "test"), spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}


def test_members_far_from_the_hub_are_linked(spark):
    """Copies of one base with more and more words changed: neighbours are near, the ends are not."""
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(300)] = f"x{rng.randint(0, 10**6)}"
    rng.shuffle(rows)
    df = numbered(Scratch(spark, "test"), spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in near_dup.near_duplicates(df).collect()} == {0}


def test_components_of_a_long_chain(spark):
    nodes = list(range(10_001))
    random.Random(1).shuffle(nodes)
    scratch = Scratch(spark, "test")
    got = components(scratch, spark.createDataFrame(list(zip(nodes, nodes[1:])) + [(20_005, 20_001)], "a long, b long"))
    assert {(r.component, r["count"]) for r in got.groupBy("component").count().collect()} == {(0, 10_001), (20_001, 2)}
    assert scratch.n < 2 + 2 * 25


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    pairs = [(np.unique(base[:1500]), np.unique(base[300:1800])), (np.unique(base), np.unique(base[:1000]))]
    for a, b in pairs:
        ra, rb = near_dup.registers([a, b])
        assert (np.maximum(ra, rb) == near_dup.registers([np.union1d(a, b)])[0]).all()  # sketches merge
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = near_dup.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(est - true) < 0.2


def cut_by_hand(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    want = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return want


def cut_by_operator(spark, rows, path, *args):
    spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, hash long, __row long").repartition(3).write.parquet(path)
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.cut_repeats(spark.read.parquet(path), *args).collect())


def test_repeats(spark, docs, none, tmp_path):
    rows = texts(docs) + [(500, "ab" * 100), (501, "x" * 59), (502, "y" * 130)]
    assert cut_by_operator(spark, rows, str(tmp_path / "docs"), 60, 16) == cut_by_hand(rows, 60)
    assert repeats.cut_repeats(none).count() == 0


def test_repeats_of_a_gram_in_many_surroundings(spark, tmp_path):
    """Shards of 3,000 bytes, and one phrase of 40 bytes between random words, some of them equal on one side."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    phrase, sides = "the phrase that very many documents hold", [say(40) for _ in range(6)]
    rows = []
    for i in range(300):
        left, right = rng.choice(sides), rng.choice(sides)
        rows.append((i, left[rng.randrange(len(left)) :] + phrase + right[: rng.randrange(len(right))] + say(20)))
    got = cut_by_operator(spark, rows, str(tmp_path / "docs"), 220, 32, 3000)
    assert got == cut_by_hand(rows, 220) and sum(n for _, _, n, _, _ in got) > 10_000


def test_minimisers_are_chosen_by_content():
    rng = np.random.default_rng(4)
    for _ in range(60):
        b = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(60, 400))).astype(np.uint8)
        place, _, first, last = repeats.minimisers(b, 16, 60)
        assert first[0] == 0 and last[-1] == len(b) - 60 and (first[1:] == last[:-1] + 1).all()
        at = {}
        for p, x, y in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
            assert all(at.setdefault(b[w : w + 60].tobytes(), p - w) == p - w and 0 <= p - w <= 44 for w in range(x, y + 1))


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, k = int(rng.integers(1, 300)), int(rng.integers(1, 5))
        t = rng.integers(1, 1 + k, n)
        b = bytes(t.astype(np.uint8))
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
        shared = common_with_previous(t, sa, 50)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            c = next((c for c in range(50) if b[i + c : i + c + 1] != b[j + c : j + c + 1] or i + c >= n), 50)
            assert shared[i] == c or (shared[i] > c and max(i, j) + c >= n)


def test_token_counts(spark, docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = token_counts.Unigram.load(path)

    def one(word):
        w = "▁" + word
        best = [(0.0, 0)] + [None] * len(w)
        for e in range(1, len(w) + 1):
            n = len(w[e - 1].encode())
            options = [(best[e - 1][0] + model.byte * n, best[e - 1][1] + n)]
            options += [(best[s][0] + model.scores[w[s:e]], best[s][1] + 1) for s in range(e) if w[s:e] in model.scores]
            top = max(o[0] for o in options)
            best[e] = (top, min(o[1] for o in options if o[0] == top))
        return best[-1][1]

    memo = {}
    rows = texts(docs) + [(600, "Ünïcödé 你好 ☃ x"), (601, "z" * 3000)]
    want = Counter()
    for i, t in rows:
        ws = WORD.findall(t or "")
        want[i, len(ws), len((t or "").encode()), sum(memo.setdefault(w, one(w)) if w not in memo else memo[w] for w in ws)] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in token_counts.token_counts(df, path).collect()) == want
    assert token_counts.token_counts(none, path).count() == 0
    assert math.isclose(sum(map(math.exp, model.scores.values())), 1.0, rel_tol=1e-9)


def test_prefix_filter_loses_no_pair_and_leaves_few(spark):
    """Edited copies of a hub, versions of it that share a passage, and chains of edits: all pairs above the threshold, few others."""
    rng = random.Random(21)
    fresh = iter(range(10**6, 10**9))
    hub = [next(fresh) for _ in range(200)]
    sets, component = {0: frozenset(hub)}, {}

    def edited(base, n):
        out = list(base)
        for k in rng.sample(range(len(out)), n):
            out[k] = next(fresh)
        return frozenset(out)

    version = [next(fresh) for _ in range(40)] + hub[40:]
    for i in range(1, 241):
        sets[i] = edited(hub, rng.randint(17, 22)) if i <= 160 else edited(version, rng.randint(0, 6)) if i <= 190 else edited(sets[i - 1], 7) | {next(fresh)} if i > 210 else edited(sets[i - 3], 2)
    jaccard = lambda x, y: len(x & y) / len(x | y)
    for t in ((85, 100), (80, 100)):
        near = {(a, b) for a in sets for b in sets if 0 < a < b and jaccard(sets[a], sets[b]) >= t[0] / 100}
        linked = {a for a in sets if jaccard(sets[a], sets[0]) >= t[0] / 100}
        component = {a: 0 if a in linked else a for a in sets}
        want = {(a, b) for a, b in near if component[a] != component[b]}
        binary = spark.createDataFrame([(i, np.sort(np.array(list(s), np.uint64)).tobytes()) for i, s in sets.items()], "node long, members binary")
        group = spark.createDataFrame([(0, i, component[i]) for i in sets if i], "hub long, node long, component long")
        got = {(r.a, r.b) for r in near_dup.apart_pairs(Scratch(spark, "test"), group, binary, t).collect()}
        assert want and want <= got
        assert len(got - want) < 0.1 * len(sets) ** 2 / 2
