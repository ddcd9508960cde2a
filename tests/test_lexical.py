from lexforest.operators import combine, lexical
from lexforest.plans import lca


def table(spark, rows):
    return spark.createDataFrame([(d, i, w, t) for d, ws in rows.items() for i, (w, t) in enumerate(ws)], "doc_id long, pos int, lemma string, tag string")


ROWS = {
    1: [("dog", "NOUN"), ("run", "VERB"), ("dog", "NOUN"), ("quick", "ADJ"), ("quickly", "ADV"), ("very", "ADV"), (".", "PUNCT"), ("7", "NUM"), ("x-1", "X")],
    2: [("dog", "NOUN")] * 60,
}


def test_classes_and_counts(spark):
    toks = table(spark, ROWS)
    # a lemma may stand twice in a list
    easy = spark.createDataFrame([("dog", 9, 0), ("dog", 9, 3), ("run", 5, 1), ("seven", 5, 2)], "lemma string, freq long, ins_ord long")
    adj = spark.createDataFrame([("quick",)], "lemma string")
    got = {r.doc_id: r for r in lexical.counts(lexical.classify(toks, lexical.easy_words(easy, 2), adj)).collect()}
    r = got[1]
    assert (r.word_t, r.word_n) == (6, 7)  # the mark and the odd X are no words
    assert (r.noun_t, r.noun_n, r.verb_t, r.adj_t, r.adv_t, r.adv_n) == (1, 2, 1, 1, 1, 1)  # very is no derived adverb
    assert (r.sword_t, r.lex_n, r.slex_n, r.sverb_t) == (4, 5, 3, 1)  # the number is never sophisticated
    assert got[2].word_t == 1 and got[2].word_n == 60
    per = lexical.lemma_counts(toks, "doc_id", "lemma", "tag")
    assert {x.doc_id: x for x in lexical.counts(lexical.classify(per, lexical.easy_words(easy, 2), adj)).collect()} == got


def test_matches_of_tokens(spark):
    none = spark.createDataFrame([], "lemma string")
    rows = lexical.token_matches(lexical.classify(table(spark, ROWS), none, none)).where("doc_id = 1 AND measure = 'noun_n'").orderBy("ord").collect()
    assert [(r.ord, r.match) for r in rows] == [(0, "dog"), (1, "dog")]


def test_penn_classes(spark):
    toks = table(spark, {1: [("be", "VBZ"), ("go", "VBD"), ("up", "RP"), ("!", "."), ("x", ""), ("y", "SYM"), ("five", "CD")]})
    none = spark.createDataFrame([], "lemma string")
    r = lexical.counts(lexical.classify(toks, none, spark.createDataFrame([("up",)], "lemma string"), "ptb")).first()
    assert (r.word_n, r.verb_n, r.adv_n, r.sword_n) == (4, 1, 1, 3)


def test_indices_and_samples(spark):
    toks = table(spark, ROWS)
    none = spark.createDataFrame([], "lemma string, freq long, ins_ord long")
    adj = spark.createDataFrame([], "lemma string")
    rows = {r.doc_id: r.asDict() for r in lca.analyse(toks, none, adj).collect()}
    assert rows[1]["TTR"] == 6 / 7 and rows[1]["MSTTR"] == 6 / 7 and rows[1]["NDW-50"] == 6.0
    assert rows[2]["MSTTR"] == 1 / 50 and rows[2]["NDW-ER50"] == 1.0 and rows[2]["NDW-ES50"] == 1.0
    assert rows[2]["VV1"] == 0.0 and rows[2]["LogTTR"] == 0.0


def test_combining_counts_types_anew(spark):
    toks = table(spark, ROWS)
    groups = spark.createDataFrame([(1, "g", 0), (2, "g", 1)], "doc_id long, group_id string, ord int")
    none = spark.createDataFrame([], "lemma string, freq long, ins_ord long")
    r = lca.combined(toks, groups, none, spark.createDataFrame([], "lemma string")).first()
    assert r.group_id == "g" and (r.word_t, r.word_n) == (6, 67)
    one = spark.createDataFrame([(1, "g", 0)], "doc_id long, group_id string, ord int")
    assert combine.check_groups(one).count() == 1


def test_samples_of_groups_are_those_of_one_array(spark):
    rows = [(g, o, p, f"w{(g * 7 + o * 5 + p * p) % 23}", "NOUN") for g, sizes in ((1, (40, 35, 61)), (2, (20,)), (3, (50, 1))) for o, n in enumerate(sizes) for p in range(n)]
    toks = spark.createDataFrame(rows, "doc_id long, ord int, pos int, lemma string, tag string")
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "`NDW-50`", "`NDW-ER50`", "`NDW-ES50`", "MSTTR").collect())
    assert key(lexical.sampled_groups(toks)) == key(lexical.sampled(toks, order=("ord", "pos")))


def test_types_of_every_class(spark, tmp_path):
    from lexforest import queries

    text = "The quick dogs quickly saw a beautiful house and happily walked to the remarkable observatory"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.queries()["lca_types_all"](spark, str(tmp_path)).collect()
    want = queries.lexical.matches(queries.classed(spark, str(tmp_path))).select("measure", "match").collect()
    assert {(r.measure, r.match) for r in found} == {(r.measure, r.match) for r in want}
    assert {"word_t", "lex_t", "noun_t"} <= {r.measure for r in found}
