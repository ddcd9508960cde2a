"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforest.llm import exact_dedup, hard_negatives, ranked_search
from lexforest.llm.queries import oracle_sql, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked_by_force(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(Counter)
    for i, t in set(items):
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for item, bag in asked.items():
        found = []
        for doc, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n_docs) // total
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in bag.items() if b[t])
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return Counter(out)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["Ärger", "naïve", "日本", "3rd"]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", "-", ", "]).join(rng.choices(words, weight, k=rng.choice([1, 3, 20, 80, 300])))) for i in range(700)]
    docs += [(900, None), (901, ""), (902, "...!"), (None, "w0 w1 w2 Ärger"), (903, "w7 " * 5000), docs[5], docs[5], (904, docs[5][1].upper())]
    items = [(i, " ".join(rng.choices(words, weight, k=rng.choice([1, 2, 8, 30])))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "nowhere"), (None, "w0"), (53, "w3 w3 w3 W3"), items[2], (3, "w9 w11"), (54, docs[40][1])]
    return docs, items


# few and many blocks, windows and shards; with and without all terms; items in one chunk or many
@pytest.mark.parametrize(("k", "options"), [(20, {}), (3, {"shard_bytes": 3000, "block": 4, "window": 16}), (5, {"block": 8, "window": 32, "vocabulary": 10, "chunk": 60})])
def test_ranked_search(spark, corpus, k, options):
    docs, items = corpus
    d = spark.createDataFrame([(*x, "a", 1) for x in docs], "doc_id long, text string, term string, score long").repartition(3)
    q = spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, doc_id int")
    assert rows(ranked_search.ranked_search(d, q, k, **options)) == ranked_by_force(docs, items, k)
    assert ranked_search.ranked_search(d.limit(0), q, k).count() == ranked_search.ranked_search(d, q.limit(0), k).count() == 0


def test_maxscore_leaves_blocks_packed():
    """A frequent term's blocks are not unpacked once the rare term decides."""
    n = 20_000
    ids, known = np.arange(n), np.ones(n, bool)
    common, rare = np.arange(n), np.arange(0, n, 1000)
    doc, term = np.concatenate([common, rare]), np.concatenate([np.full(n, 5, np.uint64), np.full(len(rare), 9, np.uint64)])
    lengths = np.full(n, 10)
    shard = ranked_search.Shard(ranked_search.seal(ids, known, lengths, doc, term, np.ones(len(doc), np.int64)), n, 10 * n)
    top = ranked_search.Top(5)
    asked = np.array([5, 9], np.uint64)
    ranked_search.search_shard(shard, asked, ranked_search.weights_of(n, {5: n - 10, 9: len(rare)}, asked, np.array([1, 1])), top)
    assert top.ids.tolist() == [0, 1000, 2000, 3000, 4000]
    assert shard.unpacked < 0.5 * len(shard.last)


def test_block_maxima_are_exact():
    rng = np.random.default_rng(3)
    n = 500
    lengths, doc = rng.integers(5, 400, n), np.repeat(np.arange(n), 2)
    term, tf = np.tile(np.array([3, 8], np.uint64), n), rng.integers(1, 70000, 2 * n)
    shard = ranked_search.Shard(ranked_search.seal(np.arange(n)[::-1].copy(), np.ones(n, bool), lengths, doc, term, tf, 16), n, int(lengths.sum()), 16)
    for x in range(2):
        for b in range(len(shard.lasts(x))):
            assert shard.unpack(x, b, b + 1)[1].max() == shard.block_most[shard.first_block[x] + b]
    got = sorted(zip(*shard.unpack(1, 0, len(shard.lasts(1)))))
    want = sorted((n - 1 - d, int(ranked_search.Shard.part(np.array([t]), np.array([12 * (75 + 25 * int(lengths[d]) * n // int(lengths.sum()))]))[0])) for d, w, t in zip(doc, term, tf) if w == 8)
    assert got == want


# ---- hard negatives


def negatives_by_force(vectors, every=100, k=5):
    known = [(i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in vectors if i is not None and y is not None and v and None not in v and all(map(math.isfinite, v))]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = Counter()
    for i, a, y in known:
        if i % every:
            continue
        pos = sorted((-dot(a, b), j) for j, b, z in known if z == y and j != i)[:k]
        neg = [(-dot(a, b), j) for j, b, z in known if z != y]
        for s, j in pos:
            fit = sorted(x for x in neg if 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out.update((i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit))
    return out


def vectors_of(n, dims, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dims)) * 0.2 * scale).astype(np.float32).astype(float)
    x[n // 3 : 2 * n // 3] = x[n // 3]  # a third are copies
    return [(int(i), v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]


@pytest.mark.parametrize("scale", [1.0, 5000.0])
def test_hard_negatives(spark, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "CHUNK", 2)
    vectors = vectors_of(500, 8, 4, scale)
    vectors += [vectors[0], vectors[0], vectors[100], (7, vectors[8][1], 3), (700, None, 1), (701, [0.0] * 8, None), (800, [math.nan] * 8, 1), (801, [None] * 8, 1), (900, [0.0] * 8, 2), (None, vectors[4][1], 1), (1000, [], 1)]
    df = spark.createDataFrame([(i, v, y, 0.5, 1) for i, v, y in vectors], "vec_id long, embedding array<double>, label int, score double, rank int")
    got = rows(hard_negatives.hard_negatives(hard_negatives.labelled(df), F.col("vec_id") % 100 == 0))
    assert got == negatives_by_force(vectors) and got
    assert hard_negatives.hard_negatives(hard_negatives.labelled(df.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def test_packed_products():
    rng = np.random.default_rng(8)
    for low, high, dims in ((0, 2, 5), (-256, 257, 64), (-9, -3, 7), (0, 1, 3), (-(2**20), 2**20, 16), (-(2**27), 2**27, 9)):
        a, c = rng.integers(low, high, (11, dims)).astype(float), rng.integers(low, high, (37, dims)).astype(float)
        assert (hard_negatives.products(a, c) == a.astype(np.int64) @ c.astype(np.int64).T).all()


# ---- exact copies


def exact_by_force(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(LOWER)].append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, sha = max(known, default=None), hashlib.sha256(t.encode()).hexdigest()
        left = list(ids)
        left.remove(keep)
        out.update([(keep, keep, len(ids), True, sha), *((i, keep, len(ids), False, sha) for i in left)])
    return out


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_dedup(spark, counters):
    rng = random.Random(13)
    docs = [(i, rng.choice(["Hot Text", "hot text", "HOT TEXT", f"text {i % 50}", f"Text {i}", "ÄRGER", "ärger"])) for i in range(600)]
    docs += [(700, None), (701, ""), (None, "hot text"), (None, "alone"), (None, "alone"), docs[3], docs[3], (5, "x" * 200_000), (5, "X" * 200_000), (702, " hot text")]
    df = spark.createDataFrame([(*x, "k", 3) for x in docs], "doc_id long, text string, digest string, group_size int").repartition(5)
    found = exact_dedup.exact_dedup(df, counters)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in found.collect())
    assert got == exact_by_force(docs)
    assert exact_dedup.exact_dedup(df.limit(0), counters).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    rng = random.Random(2)
    stream = [rng.choice("ab") if rng.random() < 0.6 else str(rng.random()) for _ in range(3000)]
    summary = exact_dedup.MisraGries(5)
    for k in range(0, 3000, 70):
        summary.add(Counter(stream[k : k + 70]))
    true = Counter(stream)
    assert len(summary.of) <= 5
    for x in "ab":
        assert true[x] - 3000 / 6 <= summary.of[x] <= true[x]


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_hard_negatives", "op13_exact_dedup"])
def test_registered_queries_agree_with_sql_on_odd_tables(spark, tmp_path, corpus, name):
    duckdb = pytest.importorskip("duckdb")
    docs, items = corpus
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    vectors = [*vectors_of(300, 8, 6), (100, vectors_of(300, 8, 6)[100][1], 2), (0, None, 1), (3, [1.0] * 8, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert rows(df) == Counter(want) and want
