"""Operator 7: near-duplicate documents by SetSketch registers.

A document's set holds its distinct word shingles. Register i of its sketch is

    K_i = clip(floor(1 - log_B(min over the set of h_i)), 0, Q + 1)

with h_i exponentially distributed with rate A: a truncated minimum on an
exponentially spaced scale. Registers of a union are the maxima of the registers,
so sketches merge, and two sets agree in a register about as often as their
similarity. Bands of register values propose pairs; the similarity of a pair is
estimated jointly from how many registers are larger, smaller and equal, by
maximum likelihood with the known set sizes; pairs whose estimate is far below
the threshold (``SIGMAS`` standard errors) are dropped and all others are
verified on the full sets.

Rows with one and the same set form a class, of which the first row stands for
all. Candidates are not expanded to all pairs of a band bucket. First every member
is compared with the bucket's hub, the member that meets most others, and the
verified links are merged to components. Then only members of different
components of a bucket are compared, by a prefix filter on what parts them from their hub:
for sets x and y and a hub h, the symmetric difference of x and y is that of
D(x) = x - h + h - x and D(y), so a pair above the threshold shares a known least part of D(x) and
D(y), and that is never nothing unless both are linked to h already. Shingles that a hub's
members have in common are in no D; those that an edit made are in one only, so that among the
rarest of D(x) that must hold a common one (the prefix) hardly any leads to another member, and a
group of near copies of one text costs about as much as its members' differences. No link is lost.

A pair of similarity s shares none of the BANDS bands of ROWS registers with
probability (1 - s^ROWS)^BANDS: 5e-9 at 0.85, 6e-7 at 0.8.

Edge cases: null and empty texts have the empty set and are linked with nothing;
a text with fewer words than a shingle has one shingle, the whole sequence; rows
that share a doc_id count as linked and share the component, whatever their texts; a
null doc_id is linked with nothing and its ids are null; an empty table gives no
rows; other columns are ignored. A whole text's shingles are held at once by
one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bitmap import Bitmap
from .common import Scratch, mix64, numbered, slices, stream64, string_bytes, table, words_of
from .components import components

SHINGLE, THRESHOLD = 3, (85, 100)
BANDS, ROWS = 20, 3
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate and the largest register but one.
B, A, Q = 1.001, 20.0, 2**16 - 2
SIGMAS = 6.0
#: Shingles hashed at once.
CHUNK = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_HASHES = stream64(REGISTERS, 71) | np.uint64(1), stream64(REGISTERS, 72)


def shingle_sets(text, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow string column."""
    buf, off = string_bytes(text)
    n = len(off) - 1
    _, _, doc, h = words_of(_LOWER[buf], off)
    per = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(per)])
    odd = stream64(width, 73) | np.uint64(1)
    whole = max(0, len(h) - width + 1)
    s = np.zeros(whole, np.uint64)
    for j in range(width):
        s += np.bitwise_xor(h[j : j + whole], h[j : j + whole] >> np.uint64(31)) * odd[j]
    s = mix64(s)
    out = []
    for a, k in zip(first[:-1].tolist(), per.tolist(), strict=True):
        if k >= width:
            out.append(np.unique(s[a : a + k - width + 1]))
        elif k:
            short = np.uint64(k)
            for j in range(k):
                short = mix64(np.array([short]) * odd[0] + h[a + j])[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, a row a set; sets may not be empty."""
    multiply, flip = _HASHES
    least, chunk = np.empty((len(sets), len(flip)), np.uint64), CHUNK
    k = 0
    while k < len(sets):
        upto, size = k, 0
        while upto < len(sets) and (upto == k or size + len(sets[upto]) <= chunk):
            size += len(sets[upto])
            upto += 1
        if upto == k + 1:
            whole = sets[k]
            parts = [((whole[a : a + chunk, None] ^ flip) * multiply).min(0) for a in range(0, len(whole), chunk)]
            least[k] = np.minimum.reduce(parts)
        else:
            flat = np.concatenate(sets[k:upto])
            starts = np.cumsum([0, *(len(x) for x in sets[k : upto - 1])])
            least[k:upto] = np.minimum.reduceat((flat[:, None] ^ flip) * multiply, starts, axis=0)
        k = upto
    uniform = (least.astype(np.float64) + 1.0) * 2.0**-64
    x = np.maximum(-np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / A, 1e-300)
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS)).copy()
    for j in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, j])
    return key.view(np.int64)


def estimate(ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray, steps: int = 200) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches of sets of known sizes."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    more, less = (ku > kv).sum(1), (ku < kv).sum(1)
    same = ku.shape[1] - more - less
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    grid = np.linspace(0, 1, steps + 1)[None, :] * np.minimum(u / v, v / u)[:, None]
    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    like = more[:, None] * np.log(np.maximum(up, tiny)) + less[:, None] * np.log(np.maximum(down, tiny)) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(grid, like.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """__row, n_shingles, digest_a, digest_b (of the whole set), regs and bands."""

    def run(batches):
        import pyarrow as pa

        weight = stream64(1, 74)[0] | np.uint64(1)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(a, b - a), width)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                regs = registers([sets[i] for i in full])
                keys = band_keys(regs)
                digest = np.zeros((len(sets), 2), np.int64)
                for i in full.tolist():
                    s = sets[i]
                    digest[i, 0] = np.add.reduce(s * weight).view(np.int64)
                    digest[i, 1] = np.bitwise_xor.reduce(mix64(s)).view(np.int64)
                reg_out, band_out = [None] * len(sets), [None] * len(sets)
                for k, i in enumerate(full.tolist()):
                    reg_out[i], band_out[i] = regs[k].tobytes(), keys[k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(reg_out, pa.binary()), pa.array(band_out, pa.list_(pa.int64()))],
                    names=["__row", "n_shingles", "digest_a", "digest_b", "regs", "bands"],
                )

    return docs.select("__row", "text").mapInArrow(run, "__row long, n_shingles long, digest_a long, digest_b long, regs binary, bands array<bigint>")


def promising(pairs: DataFrame, sketch: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs a, b whose sizes allow the threshold and whose estimate is not far below it."""
    t = threshold[0] / threshold[1]
    floor = t - SIGMAS * (t * (1 - t) / REGISTERS) ** 0.5
    side = lambda x: sketch.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("na", "nb") * threshold[1] >= F.greatest("na", "nb") * threshold[0])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                col = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                regs = lambda n: np.stack([np.frombuffer(x, np.uint16) for x in col[n].to_pylist()])  # noqa: B023, E731
                j = estimate(regs("ra"), regs("rb"), col["na"].to_numpy(), col["nb"].to_numpy())
                ok = pa.array(np.flatnonzero(j >= floor))
                yield pa.RecordBatch.from_arrays([col["a"].take(ok), col["b"].take(ok)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def with_texts(scratch: Scratch, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """__row and text of the rows in nodes. Only their texts are shuffled, and few others."""
    few = Bitmap(scratch, nodes, "node").thin(docs.select("__row", "text"), "__row")
    return few.join(nodes, few["__row"] == nodes.node).select("__row", "text")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """node and members (the sorted shingle hashes) of each text."""

    def collect(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(a, b - a), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"])

    return texts.mapInArrow(collect, "node long, members binary")


def differences(group: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, node, component, n (the set's size), d and parts (the shingles in one of the node's and the hub's sets only)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            n, d, parts = [], [], []
            for x, h in zip(col["own"], col["of_hub"], strict=True):
                x, h = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(h.as_py(), np.uint64)
                parts.append(np.setxor1d(x, h, assume_unique=True).view(np.int64))
                n.append(len(x))
                d.append(len(parts[-1]))
            yield pa.RecordBatch.from_arrays(
                [col["hub"], col["node"], col["component"], pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["hub", "node", "component", "n", "d", "parts"]
            )

    both = group.join(sets.select("node", F.col("members").alias("own")), "node").join(sets.select(F.col("node").alias("hub"), F.col("members").alias("of_hub")), "hub")
    return both.mapInArrow(run, "hub long, node long, component long, n long, d long, parts array<bigint>")


def apart_pairs(scratch: Scratch, group: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs a, b of nodes of one hub and different components that the prefix filter leaves; group: hub, node, component."""
    num, den = threshold
    parted = scratch.save(differences(group, sets).select("hub", "node", "component", "n", "d", F.explode("parts").alias("part")))
    # how often a part occurs with a hub, and the component that has it most often
    each = parted.groupBy("hub", "part", "component").agg(F.count("*").alias("times"))
    lists = each.groupBy("hub", "part").agg(F.sum("times").alias("times"), F.max_by("component", F.struct("times", "component")).alias("major"), F.count("*").alias("components")).where("times > 1")
    shared = parted.join(scratch.save(lists), ["hub", "part"])
    # rarest first; parts that no other member has come before these
    own = Window.partitionBy("hub", "node")
    place = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("times", "part"))
    # of a pair, the one with the smaller difference needs the shorter prefix
    most = F.expr(f"n * {den - num} div {num}")
    placed = shared.withColumn("place", place).where((F.col("components") > 1) & (F.col("place") <= most + 1))
    placed = scratch.save(placed.select("hub", "part", "node", "component", "n", "d", "place", (F.col("component") == F.col("major")).alias("main"), (F.col("place") <= F.expr(f"n * {den - num} div {2 * num}") + 1).alias("short")))
    side = lambda df, x: df.select("hub", "part", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "component", "n", "d", "place")))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        smaller = F.struct("x_d", "x_node") < F.struct("y_d", "y_node")
        sizes = F.least("x_n", "y_n") * den >= F.greatest("x_n", "y_n") * num
        # at the first part that they share: as many may follow, and as many are needed
        follow = 1 + F.least(F.col("x_d") - F.col("x_place"), F.col("y_d") - F.col("y_place"))
        enough = 2 * (den + num) * follow >= (den + num) * (F.col("x_d") + F.col("y_d")) - (den - num) * (F.col("x_n") + F.col("y_n"))
        left, right = side(left, "x"), side(right, "y")
        on = (left.hub == right.hub) & (left.part == right.part) & (F.col("x_component") != F.col("y_component")) & smaller & sizes & enough
        return left.join(right, on).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))

    # members of a list's main component need not meet each other
    first = placed.where("short")
    return joined(first.where("NOT main"), placed).union(joined(first.where("main"), placed.where("NOT main"))).distinct()


def verified(scratch: Scratch, pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs a, b whose full sets reach the threshold."""

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            ids = [batch.column(batch.schema.names.index(c)) for c in ("a", "b")]
            ok = []
            for x, y in zip(batch.column(batch.schema.names.index("sa")), batch.column(batch.schema.names.index("sb")), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(threshold[1] * common >= threshold[0] * (len(p) + len(q) - common))
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in ids], names=["a", "b"])

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("members").alias("sb")), "b")
    return scratch.save(two.mapInArrow(check, "a long, b long").distinct())


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """__row, doc_id, n_shingles, class_id (smallest doc_id with the same set) and component_id (smallest reachable) of every row.

    docs has __row, which numbers the rows and is the same at each reading.
    """
    scratch = Scratch(docs.sparkSession, "near-dup")
    docs = docs.select("__row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = scratch.save(sketches(docs, width))
    digest = ["digest_a", "digest_b", "n_shingles"]
    ids = docs.select("__row", "doc_id")
    sized = sketch.select("__row", *digest).join(ids, "__row")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = sized.where(linked).groupBy(*digest).agg(F.min("__row").alias("node"), F.min("doc_id").alias("class_id"))
    member = sized.join(classes, digest, "left")
    node = F.when(linked, F.col("node")).otherwise(F.col("__row"))
    member = scratch.save(member.select("__row", "doc_id", "n_shingles", node.alias("node"), F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")))
    # one sketch a class
    heads = member.where("node = __row AND n_shingles > 0 AND doc_id IS NOT NULL").select("node")
    own = scratch.save(sketch.join(heads, sketch["__row"] == heads.node).select("node", "n_shingles", "regs", "bands"))
    scratch.drop(sketch)
    posted = own.select("node", F.posexplode("bands").alias("band", "key"))
    shared = posted.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    bucket = scratch.save(posted.join(shared, ["band", "key"]).select("band", "key", "n", "node"))
    # the member that meets most others is likeliest to be what the others were made from
    degree = bucket.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = bucket.join(degree, "node").groupBy("band", "key").agg(F.max(F.struct("degree", (-F.col("node")).alias("low"))).alias("hub"))
    hubs = hubs.select("band", "key", (-F.col("hub.low")).alias("hub"))
    met = scratch.save(bucket.join(hubs, ["band", "key"]).select("band", "key", "node", "hub"))
    ordered = [F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")]
    stars = scratch.save(met.where("node <> hub").select(*ordered).distinct())
    hopeful = scratch.save(promising(stars, own, threshold))
    texts = with_texts(scratch, docs, scratch.save(ends_of(hopeful)))
    sets = scratch.save(full_sets(texts, width))
    links = verified(scratch, hopeful, sets, threshold)
    scratch.drop(sets, bucket)
    found = components(scratch, links)

    # members of one bucket that are still apart
    labelled = met.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "key")
    apart = scratch.save(labelled.join(mixed, ["band", "key"]).where("node <> hub").select("hub", "node", "component").distinct())
    needed = scratch.save(apart.select("node").union(apart.select("hub")).distinct())
    sets = scratch.save(full_sets(with_texts(scratch, docs, needed), width))
    pairs = apart_pairs(scratch, apart, sets, threshold)
    pairs = scratch.save(promising(pairs.join(stars, ["a", "b"], "left_anti"), own, threshold))
    rest = verified(scratch, pairs, sets, threshold)

    # rows of one doc_id but of different sets
    several = member.where(linked).groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a <> high")
    same_id = member.where(linked).join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    found = components(scratch, links.union(rest).union(same_id))
    joined = member.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return joined.join(least, "component").select("__row", "doc_id", "n_shingles", "class_id", "component_id")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(Scratch(spark, "near-dup"), table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = near_duplicates(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")
