"""Lexical complexity: word classes, type and token counts, and indices.

Input is a table of tokens (doc_id, pos, lemma, tag). A document's counts come
from two aggregates, by document and lemma and then by document, so no distinct
aggregate is expanded; word lists are joined once. Classes depend on lemma and tag only,
so rows may also be aggregated already: a column n then says how many tokens a row stands for,
and first where the first of them stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import chunk_of, safe_div, safe_log

CLASSES = ("word", "sword", "lex", "slex", "noun", "verb", "sverb", "adj", "adv")
#: How the classes are called in lists of measures.
CLASS_NAMES = {"word": "words", "sword": "sophisticated words", "lex": "lexical words", "slex": "sophisticated lexical words", "noun": "nouns", "verb": "verbs", "sverb": "sophisticated verbs", "adj": "adjectives", "adv": "adverbs"}
EASY, SECTION, TRIALS = 2000, 50, 10
#: Samples that the hashes hold which are sorted for one.
SPARE = 2.5
#: Adverbs up to which their list is broadcast.
BROADCAST = 1 << 20

# The published indices and their names.
#: name -> formula over <class>_t (types) and <class>_n (tokens); ratios are one division of whole numbers.
INDICES = {
    "LD": lambda c: safe_div(c("lex_n"), c("word_n")),
    "LS1": lambda c: safe_div(c("slex_n"), c("lex_n")),
    "LS2": lambda c: safe_div(c("sword_t"), c("word_t")),
    "VS1": lambda c: safe_div(c("sverb_t"), c("verb_n")),
    "VS2": lambda c: safe_div(c("sverb_t") * c("sverb_t"), c("verb_n")),
    "CVS1": lambda c: safe_div(c("sverb_t"), F.sqrt(c("verb_n") * 2)),
    "NDW": lambda c: c("word_t").cast("double"),
    "TTR": lambda c: safe_div(c("word_t"), c("word_n")),
    "CTTR": lambda c: safe_div(c("word_t"), F.sqrt(c("word_n") * 2)),
    "RTTR": lambda c: safe_div(c("word_t"), F.sqrt(c("word_n"))),
    "LogTTR": lambda c: safe_div(safe_log(c("word_t")), safe_log(c("word_n"))),
    "Uber": lambda c: safe_div(F.pow(safe_log(c("word_n"), 10), F.lit(2.0)), safe_log(safe_div(c("word_n"), c("word_t")), 10)),
    "VV1": lambda c: safe_div(c("verb_t"), c("verb_n")),
    "SVV1": lambda c: safe_div(c("verb_t") * c("verb_t"), c("verb_n")),
    "CVV1": lambda c: safe_div(c("verb_t"), F.sqrt(c("verb_n") * 2)),
    "LV": lambda c: safe_div(c("lex_t"), c("lex_n")),
    "VV2": lambda c: safe_div(c("verb_t"), c("lex_n")),
    "NV": lambda c: safe_div(c("noun_t"), c("noun_n")),
    "AdjV": lambda c: safe_div(c("adj_t"), c("lex_n")),
    "AdvV": lambda c: safe_div(c("adv_t"), c("lex_n")),
    "ModV": lambda c: safe_div(c("adv_t") + c("adj_t"), c("lex_n")),
}
SAMPLED = ("NDW-50", "NDW-ER50", "NDW-ES50", "MSTTR")
DESCRIPTIONS = {
    "LD": "lexical density", "LS1": "lexical sophistication I", "LS2": "lexical sophistication II", "VS1": "verb sophistication I", "VS2": "verb sophistication II", "CVS1": "corrected verb sophistication",
    "NDW": "number of different words", "NDW-50": "different words among the first 50", "NDW-ER50": "different words of random samples of 50", "NDW-ES50": "different words of random sequences of 50",
    "TTR": "type-token ratio", "MSTTR": "mean segmental type-token ratio", "CTTR": "corrected type-token ratio", "RTTR": "root type-token ratio", "LogTTR": "bilogarithmic type-token ratio", "Uber": "Uber index",
    "VV1": "verb variation I", "SVV1": "squared verb variation", "CVV1": "corrected verb variation", "LV": "lexical word variation", "VV2": "verb variation II", "NV": "noun variation", "AdjV": "adjective variation", "AdvV": "adverb variation", "ModV": "modifier variation",
}


def easy_words(frequencies: DataFrame, n: int = EASY) -> DataFrame:
    """lemma of the n most frequent rows of (lemma, freq, ins_ord); ties to the smaller ins_ord."""
    return frequencies.orderBy(F.desc("freq"), "ins_ord").limit(n).select("lemma")


def corpus_frequencies(tokens: DataFrame) -> DataFrame:
    """A word list from the corpus itself: lemma, freq, and the lemma as its order."""
    return tokens.groupBy("lemma").agg(F.count("*").alias("freq")).withColumn("ins_ord", F.col("lemma"))


def is_misc(lemma: Column, tag: Column, tagset: str) -> Column:
    """Not a word: blank, without letter or digit, or a tag of marks and symbols."""
    nothing = F.coalesce(~lemma.rlike(r"[\p{L}\p{N}]"), F.lit(True)) | F.coalesce(tag == "", F.lit(True))
    if tagset == "ud":
        return nothing | tag.isin("PUNCT", "SYM", "SPACE") | ((tag == "X") & ~lemma.rlike(r"^\p{L}+$"))
    return nothing | tag.rlike(r"^[!-/:-@\[-`{-~]") | tag.isin("SENT", "SYM", "HYPH")


def word_class(lemma: Column, tag: Column, is_adverb_lemma: Column, tagset: str) -> Column:
    """noun, adj, adv or verb by that priority, else null."""
    if tagset == "ud":
        noun, adj, adv, verb = tag.isin("NOUN", "PROPN"), tag == "ADJ", tag == "ADV", tag == "VERB"
    else:
        noun, adj, adv = tag.startswith("N"), tag.startswith("J"), tag.startswith("R")
        verb = tag.startswith("V") & ~lemma.isin("be", "have")
    return F.when(noun, "noun").when(adj, "adj").when(adv & is_adverb_lemma, "adv").when(verb, "verb")


def lemma_counts(tokens: DataFrame, *keys: str) -> DataFrame:
    """keys, n (tokens) and first (least pos): what the counts of a text need of it."""
    return tokens.groupBy(*keys).agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def classify(tokens: DataFrame, easy: DataFrame, adjectives: DataFrame, tagset: str = "ud") -> DataFrame:
    """Words only, with class (noun, adj, adv, verb or null) and soph. easy: at most a few thousand lemmas."""
    return with_classes(tokens, easy, adjectives.select("lemma").union(adjectives.select(F.concat("lemma", F.lit("ly")))).distinct(), tagset)


def adverb_lemmas(known: DataFrame) -> DataFrame:
    """Of a vocabulary with one tag a lemma, the adverbs that classify takes as such: broadcast, unless there are very many."""
    of_adjective = known.where("tag = 'ADJ'").select(F.concat("lemma", F.lit("ly")).alias("lemma"))
    found = known.where("tag = 'ADV'").select("lemma").join(of_adjective, "lemma", "left_semi").distinct().persist()
    return F.broadcast(found) if found.limit(BROADCAST + 1).count() <= BROADCAST else found


def with_classes(tokens: DataFrame, easy: DataFrame, adverbs: DataFrame, tagset: str = "ud") -> DataFrame:
    """What classify gives, by the list of the lemmas that are adverbs where they are tagged so."""
    number = "NUM" if tagset == "ud" else "CD"
    words = tokens.where(~is_misc(F.col("lemma"), F.col("tag"), tagset))
    # the list of easy words has a fixed bound; that of adverbs is joined as its size asks
    out = words.join(F.broadcast(easy.select("lemma").distinct().withColumn("easy", F.lit(True))), "lemma", "left").join(adverbs.withColumn("of_adj", F.lit(True)), "lemma", "left")
    cls = word_class(F.col("lemma"), F.col("tag"), F.coalesce("of_adj", F.lit(False)), tagset)
    return out.select(*tokens.columns, cls.alias("class"), (F.col("easy").isNull() & (F.col("tag") != number)).alias("soph"))


def membership() -> dict[str, Column]:
    """Class -> whether a classified token belongs to it."""
    cls, soph = F.col("class"), F.col("soph")
    return {
        "word": F.lit(True), "sword": soph, "lex": cls.isNotNull(), "slex": cls.isNotNull() & soph,
        "noun": cls == "noun", "verb": cls == "verb", "sverb": (cls == "verb") & soph, "adj": cls == "adj", "adv": cls == "adv",
    }


def counts(classified: DataFrame, key: str = "doc_id", once: bool = False) -> DataFrame:
    """key and <class>_t, <class>_n for the nine classes. once: a lemma has one row a key already."""
    member = {c: F.coalesce(x, F.lit(False)) for c, x in membership().items()}
    n = F.col("n") if "n" in classified.columns else F.lit(1)
    own = {c: F.when(x, n).otherwise(0).cast("long") for c, x in member.items()}
    per_lemma = classified.select(key, *(x.alias(c) for c, x in own.items())) if once else classified.groupBy(key, "lemma").agg(*(F.sum(x).alias(c) for c, x in own.items()))
    types = [F.count_if(F.col(c) > 0).alias(f"{c}_t") for c in CLASSES]
    return per_lemma.groupBy(key).agg(*types, *(F.sum(c).alias(f"{c}_n") for c in CLASSES))


def indices(counted: DataFrame, names=tuple(INDICES), key: str = "doc_id") -> DataFrame:
    return counted.select(key, *(INDICES[n](F.col).alias(n) for n in names))


def sequences(tokens: DataFrame, key: str = "doc_id", order=("pos",)) -> DataFrame:
    """key and lemmas in order; what samples and windows of a text need."""
    return tokens.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "lemma"))), lambda x: x["lemma"]).alias("lemmas"))


def ndw_first(lemmas: Column, size: int = SECTION) -> Column:
    return F.size(F.array_distinct(F.slice(lemmas, 1, size))).cast("double")


def ndw_random(key: Column, lemmas: Column, size: int = SECTION, trials: int = TRIALS) -> Column:
    """Mean distinct words of random samples; a sample is the words of the smallest md5 of key, trial and place.

    Only hashes below a bound are sorted, under which about SPARE times a sample lies; all of them if there are fewer than a sample.
    """
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    share = F.lit(float(SPARE * size)) / F.size(lemmas)
    bound = F.when(share >= 1, F.lit("g")).otherwise(F.lpad(F.lower(F.hex((share * F.lit(float(1 << 32))).cast("long"))), 8, "0"))

    def trial(t: Column, bound: Column) -> Column:
        start = F.concat_ws("|", key.cast("string"), t.cast("string"), F.lit(""))
        tagged = let(start, lambda start: F.transform(lemmas, lambda w, i: F.struct(F.md5(F.concat(start, i.cast("string"))).alias("h"), w.alias("w"))))
        chosen = lambda xs, few: F.when(F.size(few) >= size, few).otherwise(xs)
        drawn = let(tagged, lambda xs: let(F.filter(xs, lambda x: x["h"] < bound), lambda few: F.slice(F.array_sort(chosen(xs, few)), 1, size)))
        return F.size(F.array_distinct(F.transform(drawn, lambda x: x["w"])))

    total = let(bound, lambda bound: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: trial(t, bound)), F.lit(0), lambda s, x: s + x))
    return F.when(F.size(lemmas) <= size, F.size(F.array_distinct(lemmas)).cast("double")).otherwise(total / F.lit(float(trials)))


def ndw_window(key: Column, lemmas: Column, size: int = SECTION, trials: int = TRIALS) -> Column:
    """Mean distinct words of contiguous samples, started where md5 of key and trial says."""
    room = F.size(lemmas) - size + 1

    def trial(t: Column) -> Column:
        start = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), t.cast("string"))), 1, 8), 16, 10).cast("long") % room
        return F.size(F.array_distinct(F.slice(lemmas, start.cast("int") + 1, F.lit(size))))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), trial), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(lemmas) <= size, F.size(F.array_distinct(lemmas)).cast("double")).otherwise(total / F.lit(float(trials)))


def msttr(lemmas: Column, size: int = SECTION) -> Column:
    """Mean type-token ratio of the complete sections, that of the text if it is shorter than one."""
    full = F.floor(F.size(lemmas) / size).cast("int")
    types = F.transform(F.sequence(F.lit(0), full - 1), lambda k: F.size(F.array_distinct(F.slice(lemmas, k * size + 1, F.lit(size)))))
    whole = safe_div(F.size(F.array_distinct(lemmas)), F.size(lemmas))
    return F.when(full < 1, whole).otherwise(safe_div(F.aggregate(types, F.lit(0), lambda s, x: s + x), full * size))


def sampled(tokens: DataFrame, section: int = SECTION, trials: int = TRIALS, key: str = "doc_id", order=("pos",)) -> DataFrame:
    seq, k, w = sequences(tokens, key, order), F.col(key), F.col("lemmas")
    return seq.select(key, ndw_first(w, section).alias("NDW-50"), ndw_random(k, w, section, trials).alias("NDW-ER50"), ndw_window(k, w, section, trials).alias("NDW-ES50"), msttr(w, section).alias("MSTTR"))


def placed(tokens: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """key, place (from 0 over all members of the key) and lemma; order: the member's columns and then the place in the member.

    Words are numbered inside their member and moved on by the sizes of the members before it, so a
    group of many documents is never sorted or held by one task.
    """
    member = [key, *order[:-1]]
    t = tokens.select(*member, "lemma", (F.row_number().over(Window.partitionBy(*member).orderBy(order[-1])) - 1).cast("long").alias("place"))
    sizes = t.groupBy(*member).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(key).orderBy(*order[:-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*member, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return t.join(sizes, member).select(key, (F.col("place") + F.col("before")).alias("place"), "lemma")


def sampled_groups(tokens: DataFrame, section: int = SECTION, trials: int = TRIALS, key: str = "doc_id", order=("ord", "pos")) -> DataFrame:
    """What ``sampled`` gives, for groups of any size: rows instead of one array a group."""
    t, k = placed(tokens, key, order), F.col(key).cast("string")
    sizes = t.groupBy(key, "lemma").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    distinct = lambda rows, *by: rows.select(key, *by, "lemma").distinct().groupBy(key, *by).agg(F.count("*").alias("types"))
    first = distinct(t.where(F.col("place") < section)).select(key, F.col("types").cast("double").alias("NDW-50"))
    known = t.join(sizes.select(key, "n"), key)
    full = F.expr(f"n div {section}") * section
    cut = distinct(known.where(F.col("place") < full).withColumn("at", F.expr(f"place div {section}")), "at").groupBy(key).agg(F.sum("types").alias("types_of_sections"))
    # the trials of groups that are longer than a section
    asked = sizes.where(F.col("n") > section).select(key, "n", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    start = F.conv(F.substring(F.md5(F.concat_ws("|", k, F.col("trial").cast("string"))), 1, 8), 16, 10).cast("long") % (F.col("n") - section + 1)
    runs = asked.select(key, "trial", F.explode(F.sequence(start, start + section - 1)).alias("place")).join(t, [key, "place"])
    hashed = known.where(F.col("n") > section).select(key, "place", "lemma", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    hashed = hashed.withColumn("h", F.md5(F.concat_ws("|", k, F.col("trial").cast("string"), F.col("place").cast("string"))))
    drawn = hashed.withColumn("r", F.row_number().over(Window.partitionBy(key, "trial").orderBy("h", "lemma"))).where(F.col("r") <= section)
    mean = lambda rows, name: distinct(rows, "trial").groupBy(key).agg((F.sum("types") / F.lit(float(trials))).alias(name))
    out = sizes.join(first, key).join(mean(drawn, "er"), key, "left").join(mean(runs, "es"), key, "left").join(cut, key, "left")
    own = F.col("types").cast("double")
    msttr_ = F.when(full < section, safe_div(F.col("types"), F.col("n"))).otherwise(safe_div(F.col("types_of_sections"), full))
    return out.select(key, "NDW-50", F.coalesce("er", own).alias("NDW-ER50"), F.coalesce("es", own).alias("NDW-ES50"), msttr_.alias("MSTTR"))


def section_types(tokens: DataFrame, section: int = SECTION) -> DataFrame:
    """doc_id, chunk, types and tokens of every section."""
    t = tokens.withColumn("chunk", chunk_of(F.col("pos"), section))
    return t.groupBy("doc_id", "chunk").agg(F.count_distinct("lemma").alias("types"), F.count("*").alias("tokens"))


def _of_classes(classified: DataFrame, ending: str) -> DataFrame:
    found = F.filter(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.lit(f"{c}_{ending}")) for c, x in membership().items())), lambda m: m.isNotNull())
    return classified.withColumn("measure", F.explode(found))


def types_in_order(classified: DataFrame, classes=CLASSES) -> DataFrame:
    """What matches gives, from rows of which a lemma has one a document already: one sort of these by document, however many classes they are of."""
    member = {c: F.coalesce(membership()[c], F.lit(False)) for c in classes}
    wanted = F.lit(False)
    for x in member.values():
        wanted = wanted | x
    so_far = Window.partitionBy("doc_id").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    placed = classified.where(wanted).select("doc_id", "lemma", "first", *(x.alias(c) for c, x in member.items()))
    placed = placed.withColumns({f"{c}_ord": F.when(F.col(c), F.count_if(c).over(so_far) - 1) for c in classes})
    own = F.array(*(F.struct(F.lit(f"{c}_t").alias("measure"), F.col(f"{c}_ord").alias("ord")) for c in classes))
    return placed.select("doc_id", F.inline(own), F.col("lemma").alias("match")).where("ord IS NOT NULL").select("doc_id", "measure", "ord", "match")


def matches(classified: DataFrame) -> DataFrame:
    """doc_id, measure, ord and match: types of a class in order of first occurrence."""
    at = "first" if "first" in classified.columns else "pos"
    long = _of_classes(classified, "t").groupBy("doc_id", "measure", "lemma").agg(F.min(at).alias("first"))
    w = Window.partitionBy("doc_id", "measure").orderBy("first")
    return long.select("doc_id", "measure", (F.row_number().over(w) - 1).alias("ord"), F.col("lemma").alias("match"))


def token_matches(classified: DataFrame) -> DataFrame:
    """doc_id, measure, ord and match: tokens of a class in order."""
    w = Window.partitionBy("doc_id", "measure").orderBy("pos")
    return _of_classes(classified, "n").select("doc_id", "measure", (F.row_number().over(w) - 1).alias("ord"), F.col("lemma").alias("match"))
