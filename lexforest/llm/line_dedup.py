"""Operator 4: line deduplication with a segment-partition edit join (DataFrame functions only).

A line is dropped if an equal line stands earlier (by doc_id, then row and place), however short,
or if it has LEAST characters or more and a line within EDITS insertions, deletions and replacements
of it has its first occurrence earlier. (Two edits make another word of a shorter line.)

The edit join cuts a line into m segments of one size, of which two edits touch two
at most: whichever two are left out, the others stand in the other line too, those
before the first edit at their place from the start, those after the last edit at
their place from the end, and those between them shifted by one character at most.
With m = EDITS + 1 one segment is left, and a line has three keys of its own and
two shifted ones. The size steps with the length, so that lines of nearly
one length have the same; a line near a step has the keys of the step below too.

Keys that only one line has are dropped by a partial aggregate of (key, least line,
greatest line) and a bitmap; then keys are joined exactly. A line needs *one*
earlier near line only, so each key's lines are compared with its first line
(and its first line that has the key as its own), and those that are near are done.
Lines that are left are compared with all earlier ones of their key where the key is small; in a
key of more than FEW lines that is not worth cutting up, a semi-join looks for one earlier line by what the key leaves out.
The lines of a key agree in all but the two segments that it leaves out, and for one of their
keys two near lines differ by their edits in these only. So the lines of a large key get new
keys from what these segments hold, without the start and the end that all lines of
the key share there: what is left of it after up to two deletions if that is short (WIDTH),
as in boilerplate with a number in it; if it is not, lines are cut into more segments (LEVELS), and
at the last of these into halves without a character. Lines are compared by length and character parities, and then
by the banded bit-parallel edit distance.

Segments of short lines are too frequent for keys, so lines below NEAR (and up to
EDITS more, to meet those beyond) are made distinct first and have other keys. Below
HALVES: what is left of a line after up to two deletions; lines within two edits
leave the same if the longer loses two characters. From HALVES: the first and the
last half with one character deleted, since one half has one edit at most.

Edge cases: null and empty texts have no lines to drop; lines of
white space stay; of repeated rows the first (in the table's order) keeps its
lines; a null doc_id stands before all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import Bitmap
from .common import Scratch, numbered, table
from .edits import shared_start, within
from .ordering import globally_sorted, ranked

EDITS, LEAST, NEAR = 2, 10, 40
#: From this length on, up to NEAR, keys are made of half a line.
HALVES = 20
#: Segments of a line: at first, and in keys that are cut up.
LEVELS = (3, 6, 12)
#: Comparisons that cost as much as one key, and lines of a key that are compared with each other anyway.
PER_KEY, FEW = 4, 64
#: Characters of what a large key's lines differ in, up to which it gives keys of deletions.
WIDTH = 24
#: Parts the two segments that a key leaves out.
MARK = "\u0000"
ORDER = ("doc_id", "__row", "place")


def lines_of(docs: DataFrame) -> DataFrame:
    """__row, doc_id, place (from 0) and line of every line."""
    text = F.col("text").cast("string")
    return docs.select("__row", F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("place", "line"))


def candidates_of(lines: DataFrame) -> DataFrame:
    """Lines that take part, with two 64-bit hashes."""
    lines = lines.where(F.col("line").rlike(r"\S"))
    return lines.withColumns({"id": F.xxhash64("line"), "id2": F.xxhash64(F.lit(1), "line")})


def segment_size(length: Column, m: int) -> Column:
    """A size of which m fit into a line of that length: at most a quarter less than would fit, in steps."""
    most = F.floor(length / m).cast("int")
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.floor(F.log2(most)).cast("int") - 2, F.lit(0)))
    return F.floor(most / step).cast("int") * step


def segment_key(m: int, size: Column, first, last, shift) -> Column:
    """Key of a line (columns line, __len) without segments first < last; those between them stand shift later."""
    first, last, shift = (F.lit(x) if isinstance(x, int) else x for x in (first, last, shift))
    after = (F.lit(m - 1) - last) * size
    line = F.col("line")
    parts = (F.substring(line, F.lit(1), first * size), F.substring(line, (first + 1) * size + shift + 1, (last - first - 1) * size), F.substring(line, F.col("__len") - after + 1, after))
    return F.xxhash64(F.lit(m), size, first, last, *parts)


def choices(m: int) -> list[tuple[int, int, int]]:
    """(first, last, shift) of all keys of m segments; those without a shift come first."""
    every = [(i, j, s) for i in range(m) for j in range(i + 1, m) for s in ((0, 1, -1) if j > i + 1 else (0,))]
    return sorted(every, key=lambda x: x[2] != 0)


def first_keys(length: Column, m: int) -> tuple[Column, int]:
    """All keys of a line as an array, and how many of the first ones are its own."""
    own, below = F.col("__size"), F.col("__below")
    keys = lambda size: [segment_key(m, size, *c) for c in choices(m)]
    return F.when(own == below, F.array(*keys(own))).otherwise(F.array(*keys(own), *keys(below))), sum(c[2] == 0 for c in choices(m))


def with_sizes(lines: DataFrame, m: int, edits: int) -> DataFrame:
    length = F.char_length("line")
    return lines.withColumns({"__len": length, "__size": segment_size(length, m), "__below": segment_size(length - edits, m)})


def code_of(m, first, last, shift, below) -> Column:
    """A key's place in one number: segments, those left out, the shift, and whether it is one of the step below."""
    return (((F.lit(m) * 32 + first) * 32 + last) * 8 + (shift + 1) * 2 + below.cast("int")).cast("int")


def first_codes(m: int) -> Column:
    """The codes of first_keys, in its order."""
    return F.array(*(code_of(m, *(F.lit(x) for x in c), F.lit(b)) for b in (False, True) for c in choices(m)))


def left_out(lines: DataFrame, edits: int) -> DataFrame:
    """Adds r1 and r2, what the two segments hold that the key (column code) of a line leaves out.

    Neighbouring segments are one rest (r1): the place between them moves with an edit before it.
    """
    place = {"m": F.expr("code div 8192"), "first": F.expr("code div 256 % 32"), "last": F.expr("code div 8 % 32"), "shift": F.expr("code div 2 % 4 - 1"), "below": F.expr("code % 2")}
    at = lines.withColumns({f"__{n}": c.cast("int") for n, c in place.items()}).withColumn("__len", F.char_length("line"))
    at = at.withColumn("__size", segment_size(F.col("__len") - F.col("__below") * edits, F.col("__m")))
    r1 = F.expr("substring(line, __first * __size + 1, if(__last = __first + 1, __len - (__m - 2) * __size, __size + __shift))")
    r2 = F.expr("if(__last = __first + 1, '', substring(line, __last * __size + __shift + 1, __len - (__m - 1 - __last) * __size - __last * __size - __shift))")
    return at.withColumns({"r1": r1, "r2": r2}).drop("__m", "__first", "__last", "__shift", "__below", "__len", "__size")


def finer_keys(lines: DataFrame, m: int, edits: int) -> DataFrame:
    """no, own, code and key of lines (columns no, line) cut into m segments."""
    size = F.explode(F.array_distinct(F.array("__size", "__below")))
    of = with_sizes(lines, m, edits).select("no", "line", "__len", "__size", size.alias("size"))
    of = of.where("size > 0").select("*", F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(s).alias("s")) for i, j, s in choices(m)))))
    own = (F.col("s") == 0) & (F.col("size") == F.col("__size"))
    code = code_of(m, F.col("i"), F.col("j"), F.col("s"), F.col("size") != F.col("__size"))
    return of.select("no", own.alias("own"), code.alias("code"), segment_key(m, F.col("size"), F.col("i"), F.col("j"), F.col("s")).alias("key"))


def keyed_by_deletions(lines: DataFrame, *shared: str) -> DataFrame:
    """id, own and key of each string left after up to two deletions (from columns id, line); own ones lack two characters.

    shared: columns that lines of a key must share as well.
    """
    length = F.char_length("line")
    # a place beyond the end deletes nothing
    at = lines.withColumn("i", F.explode(F.sequence(F.lit(1), length + 1)))
    at = at.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.greatest(length, F.col("i")) + 1)))
    left = F.expr("concat(substring(line, 1, i - 1), substring(line, i + 1, j - i - 1), substring(line, j + 1))")
    return at.select("id", (F.col("j") <= length).alias("own"), F.xxhash64(F.lit("deletions"), *shared, left).alias("key"))


def keyed_by_halves(lines: DataFrame, *shared: str) -> DataFrame:
    """id, own and key of the halves of a line (columns id, line), and of a line of up to two characters less, without one character."""
    length = F.char_length("line")
    parts = []
    for less in (0, 1):
        first, last = F.floor(length / 2).cast("int") - less, F.ceil(length / 2).cast("int") - less
        for side, part in (("first", F.substring(F.col("line"), F.lit(1), first)), ("last", F.substring(F.col("line"), length - last + 1, last))):
            parts.append(F.struct(F.lit(less == 0).alias("own"), F.lit(side).alias("side"), part.alias("part")))
    at = lines.select("id", *shared, F.explode(F.array(*parts)).alias("p")).select("id", *shared, "p.*")
    at = at.withColumn("i", F.explode(F.sequence(F.lit(1), F.char_length("part"))))
    left = F.expr("concat(substring(part, 1, i - 1), substring(part, i + 1))")
    return at.select("id", "own", F.xxhash64("side", *shared, left).alias("key"))


def parity(line: Column) -> Column:
    """64 bits: whether characters of each of 64 kinds occur an odd number of times."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(c), F.lit(64)))))


def shared_keys(rows: DataFrame, line: str) -> DataFrame:
    """The keys that more than one line has."""
    return rows.groupBy("key").agg(F.min(line).alias("low"), F.max(line).alias("high")).where("low <> high").select("key")


def both_within(t: tuple[Column, Column], p: tuple[Column, Column], edits: int) -> Column:
    """Whether the two rests of one line are at most so many edits from those of another, together."""
    size = sum((F.abs(F.char_length(x) - F.char_length(y)) for x, y in zip(t, p, strict=True)), F.lit(0))
    same = [x == y for x, y in zip(t, p, strict=True)]
    split = reduce(Column.__or__, (within(t[0], p[0], n) & within(t[1], p[1], edits - n) for n in range(1, edits)), F.lit(False))
    return (size <= edits) & ((same[0] & within(t[1], p[1], edits)) | (same[1] & within(t[0], p[0], edits)) | (~same[0] & ~same[1] & split))


class EditJoin:
    """Marks the lines that have an earlier line within the edits.

    lines: no (their order), line, size and odd of every line that shares a key.
    """

    def __init__(self, scratch: Scratch, lines: DataFrame, edits: int):
        self.scratch, self.lines, self.edits = scratch, lines, edits
        self.found: DataFrame | None = None

    def _close(self, t: str, p: str) -> Column:
        # an edit changes a line's length by one at most, and two bits of its parities at most
        sizes = F.abs(F.col(f"{t}.size") - F.col(f"{p}.size")) <= self.edits
        return sizes & (F.bit_count(F.col(f"{t}.odd").bitwiseXOR(F.col(f"{p}.odd"))) <= 2 * self.edits)

    def _mark(self, pairs: DataFrame) -> None:
        """Adds the t of pairs (t, p) that are within the edits."""
        text = lambda x: self.lines.select(F.col("no").alias(x), F.col("line").alias(f"line_{x}"))
        both = pairs.distinct().join(text("t"), "t").join(text("p"), "p")
        self._add(both.where(within(F.col("line_t"), F.col("line_p"), self.edits)).select(F.col("t").alias("no")))

    def _add(self, near: DataFrame) -> None:
        near = self.scratch.save(near.distinct())
        self.found = near if self.found is None else self.scratch.save(self.found.union(near).distinct())

    def _search(self, led: DataFrame, rest: DataFrame | None) -> None:
        """Adds the open lines of larger keys that have an earlier line within the edits. One is enough, so that no pairs come of a key.

        rest: what the keys with a code leave out of their lines; the lines of others are short or few, and are compared as they are.
        """
        # a key is left where it is: only its open lines say whether it is read
        of = led.join(led.where("open").select("key").distinct(), "key")
        texts = of.where("code IS NULL").join(self.lines.select("no", F.col("line").alias("r1"), F.lit("").alias("r2")), "no")
        texts = texts.select("key", "own", "open", "t", "r1", "r2")
        if rest is not None:
            texts = texts.union(of.where("code IS NOT NULL").join(rest.select("key", "no", "r1", "r2"), ["key", "no"]).select("key", "own", "open", "t", "r1", "r2").distinct())
        texts = self.scratch.save(texts)
        if texts.isEmpty():
            return
        side = lambda x: texts.where("open" if x == "t" else "true").select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("own", "r1", "r2")), F.col("t").alias(x))
        left, right = side("t"), side("p")
        rests = ((F.col(f"r1_{x}"), F.col(f"r2_{x}")) for x in "tp")
        earlier = (F.col("own_t") | F.col("own_p")) & (F.col("p.no") < F.col("t.no")) & self._close("t", "p")
        self._add(left.join(right, (left.key == right.key) & earlier & both_within(*rests, self.edits), "left_semi").select("t.no"))

    def _rests(self, wide: DataFrame) -> DataFrame:
        """key, no, r1 and r2 (what the key leaves out of the line, without what all lines of the key share there), line (both) and width (of the key's widest), from rows of key, no, code."""
        of = self.scratch.save(left_out(wide.join(self.lines.select("no", "line"), "no"), self.edits).select("key", "no", "r1", "r2"))
        found = {}
        for r in ("r1", "r2"):
            found |= {f"{r}_low": F.min(r), f"{r}_high": F.max(r), f"{r}_back_low": F.min(F.reverse(r)), f"{r}_back_high": F.max(F.reverse(r)), f"{r}_least": F.min(F.char_length(r)), f"{r}_most": F.max(F.char_length(r))}
        per = of.groupBy("key").agg(*(c.alias(n) for n, c in found.items()))
        # the start that the first and the last in order share is that of all
        for r in ("r1", "r2"):
            per = per.withColumn(f"{r}_start", shared_start(F.col(f"{r}_low"), F.col(f"{r}_high")))
            per = per.withColumn(f"{r}_end", F.least(shared_start(F.col(f"{r}_back_low"), F.col(f"{r}_back_high")), F.col(f"{r}_least") - F.col(f"{r}_start")))
        width = sum((F.col(f"{r}_most") - F.col(f"{r}_start") - F.col(f"{r}_end") for r in ("r1", "r2")), F.lit(1))
        per = self.scratch.save(per.select("key", width.alias("width"), *(f"{r}_{x}" for r in ("r1", "r2") for x in ("start", "end"))))
        cut = [F.expr(f"substring({r}, {r}_start + 1, char_length({r}) - {r}_start - {r}_end)") for r in ("r1", "r2")]
        return self.scratch.save(of.join(per, "key").select("key", "no", cut[0].alias("r1"), cut[1].alias("r2"), F.concat(cut[0], F.lit(MARK), cut[1]).alias("line"), "width").distinct())

    def compare(self, rows: DataFrame, finer: int | None) -> DataFrame | None:
        """Compares the lines that share a key (no, own, code, key, final); returns the lines (no) that are to be cut into finer segments, if there is such a number."""
        light = self.lines.select("no", "size", "odd")
        me = F.struct("no", "size", "odd").alias("t")
        member = self.scratch.save(rows.join(light, "no").select("key", "own", "final", "code", me))
        first = lambda only: F.min(F.when(only, F.col("t")))
        lead = member.groupBy("key").agg(first(F.lit(True)).alias("any"), first(F.col("own")).alias("p"), F.count("*").alias("n"))
        led = self.scratch.save(member.join(lead, "key"))
        earlier = lambda p: (F.col(f"{p}.no") < F.col("t.no")) & self._close("t", p)
        pair = lambda p: led.where(earlier(p) & (F.col("own") | F.lit(p == "p"))).select(F.col("t.no").alias("t"), F.col(f"{p}.no").alias("p"))
        self._mark(pair("p").union(pair("any")))
        done = self.found.withColumn("done", F.lit(True))
        led = led.withColumn("no", F.col("t.no")).join(done, "no", "left").withColumn("open", F.col("done").isNull() & (F.col("any.no") < F.col("no")))
        led = self.scratch.save(led.select("key", "own", "code", "final", "no", "t", "n", "open"))

        # larger keys of which a line is open
        wide = led.where((F.col("n") > FEW) & ~F.col("final"))
        wide = self.scratch.save(wide.join(wide.where("open").select("key").distinct(), "key"))
        large, narrow, rest = None, None, None
        if not wide.isEmpty():
            rest = self._rests(wide.where("code IS NOT NULL").select("key", "no", "code"))
            # keys of deletions: so many pairs of places, each in place of so many comparisons
            keys = F.col("width") * (F.col("width") + 1) / 2 + 1
            size = wide.groupBy("key").agg(F.first("n").alias("n")).join(rest.groupBy("key").agg(F.first("width").alias("width")), "key", "left")
            dense = (F.col("width") <= WIDTH) & (F.col("n") > 2 * PER_KEY * keys)
            more = F.col("n") > (PER_KEY * len(choices(finer)) if finer else 2 * PER_KEY * F.col("width"))
            kind = F.when(dense, "deletions").when(more & F.lit(finer is not None), "finer").when(more & F.col("width").isNotNull(), "halves")
            kinds = self.scratch.save(size.select("key", kind.alias("kind")).where("kind IS NOT NULL"))
            of = lambda kind: kinds.where(F.col("kind") == kind).select("key")
            parts = rest.select("key", F.col("no").alias("id"), "line")
            narrow = keyed_by_deletions(parts.join(of("deletions"), "key").withColumnRenamed("key", "within"), "within").union(keyed_by_halves(parts.join(of("halves"), "key").withColumnRenamed("key", "within"), "within"))
            narrow = narrow.select(F.col("id").alias("no"), "own", F.lit(None).cast("int").alias("code"), "key", F.lit(True).alias("final"))
            large = wide.join(of("finer"), "key").select("no").distinct()
            led = led.join(kinds, "key", "left_anti")
        self._search(led.where(F.col("n") > FEW), rest)
        led = led.where(F.col("n") <= FEW)
        left = led.where("open").select("key", F.col("own").alias("own_t"), "t")
        right = led.select("key", F.col("own").alias("own_p"), F.col("t").alias("p"))
        pairs = left.join(right, (left.key == right.key) & (F.col("own_t") | F.col("own_p")) & (F.col("p.no") < F.col("t.no")) & self._close("t", "p"))
        self._mark(pairs.select(F.col("t.no").alias("t"), F.col("p.no").alias("p")))
        if narrow is not None:
            narrow = self.scratch.save(narrow.groupBy("no", "code", "key", "final").agg(F.max("own").alias("own")))
            if not narrow.isEmpty():
                self.compare(narrow.join(self.scratch.save(shared_keys(narrow, "no")), "key"), None)
        return large

    def run(self, rows: DataFrame) -> DataFrame:
        """no of the lines that have an earlier line within the edits."""
        for finer in (*LEVELS[1:], None):
            rest = self.compare(rows, finer)
            if rest is None or finer is None:
                break
            rest = self.scratch.save(rest)
            if rest.isEmpty():
                break
            keys = self.scratch.save(finer_keys(self.lines.join(rest, "no").select("no", "line"), finer, self.edits))
            own = keys.join(shared_keys(keys, "no"), "key").groupBy("key", "no", "code").agg(F.max("own").alias("own"))
            rows = own.withColumn("final", F.lit(False))
        return self.found


def line_dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """__row (kept from docs), doc_id, n_lines, n_exact and n_near (lines dropped) and dropped (their places) of every document."""
    if edits > 2:
        raise ValueError("lines have keys for two edits at most")
    scratch = Scratch(docs.sparkSession, "lines")
    lines, length = candidates_of(lines_of(docs)), F.char_length("line")
    keys, n_own = first_keys(length, LEVELS[0])
    seen = with_sizes(lines, LEVELS[0], edits).select(*ORDER, "id", "id2", F.when(F.col("__len") >= near, keys).alias("keys"))
    seen = scratch.save(seen)

    # keys that lines share
    short = scratch.save(lines.where((length >= least) & (length < near + edits)).select("id", "line").distinct())
    halves = min(HALVES, near)
    from_short = keyed_by_deletions(short.where(length < halves + edits)).withColumn("final", F.lit(True))
    from_short = from_short.unionByName(keyed_by_halves(short.where(length >= halves)).withColumn("final", F.lit(False))).withColumn("code", F.lit(None).cast("int"))
    from_long = seen.where("keys IS NOT NULL").select("id", F.posexplode("keys").alias("k", "key")).select("id", (F.col("k") < n_own).alias("own"), "key", F.lit(False).alias("final"), F.get(first_codes(LEVELS[0]), F.col("k")).alias("code"))
    rows = from_long.unionByName(from_short)
    shared = scratch.save(shared_keys(rows, "id"))
    few = Bitmap(scratch, shared, "key").thin(rows, "key").groupBy("key", "id", "code").agg(F.max("own").alias("own"), F.max("final").alias("final"))
    few = scratch.save(few.join(shared, "key"))

    # where lines that stand twice or share a key stand first
    ids = scratch.save(few.select("id").distinct())
    twice = seen.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    wanted = scratch.save(ids.union(twice).distinct())
    marks = Bitmap(scratch, wanted, "id")
    first = marks.thin(seen.drop("keys"), "id").groupBy("id", "id2").agg(F.min(F.struct(*ORDER)).alias("first"), F.count("*").alias("n"))
    first = scratch.save(first.join(wanted, "id"))
    texts = Bitmap(scratch, ids, "id").thin(lines.select("id", "id2", "line"), "id").distinct().join(ids, "id")
    texts = globally_sorted(scratch, texts.join(first, ["id", "id2"]).select("id", "id2", "line", F.col("first.doc_id").alias("doc_id"), F.col("first.__row").alias("row"), F.col("first.place").alias("place")), [F.col("doc_id"), F.col("row"), F.col("place")])
    texts = scratch.save(ranked(texts).select(F.col("__rank").alias("no"), "id", "id2", "line", F.char_length("line").alias("size"), parity(F.col("line")).alias("odd")))

    found = EditJoin(scratch, texts, edits).run(few.join(texts.select("id", "no"), "id").select("key", "no", "own", "final", "code"))
    near_ids = texts.join(found, "no").select("id", "id2", F.lit(True).alias("near"))
    status = first.join(near_ids, ["id", "id2"], "left").withColumn("near", F.coalesce("near", F.lit(False))).where("near OR n > 1")
    status = scratch.save(status)
    order = F.struct(*ORDER)
    marked = Bitmap(scratch, status, "id").thin(seen.drop("keys"), "id").join(status, ["id", "id2"])
    marked = marked.select("__row", "place", (F.col("first") != order).alias("exact"), (F.col("near") & (F.col("first") == order)).alias("near"))
    per = marked.where("exact OR near").groupBy("__row").agg(F.count_if("exact").alias("n_exact"), F.count_if("near").alias("n_near"), F.array_sort(F.collect_list("place")).alias("dropped"))
    out = docs.select("__row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.size(F.split(F.col("text").cast("string"), "\n")), F.lit(0)).alias("n_lines")).join(per, "__row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("__row", "doc_id", F.col("n_lines").cast("long").alias("n_lines"), zero("n_exact"), zero("n_near"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(Scratch(spark, "lines"), table(spark, sf_dir, "documents").select("doc_id", "text"))
    return line_dedup(docs).drop("__row")
