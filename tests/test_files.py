import csv
import io
import json
import zipfile

import pytest
from lexforest import cli, sinks
from lexforest.operators import cache, files
from lexforest.plans import sca
from lexforest.sources import readers
from lexforest.streaming import stream


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Grüße, Welt", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("Größe".encode("latin-1"))
    (tmp_path / ".c.txt").write_text("hidden")
    (tmp_path / "~$d.docx").write_text("hidden")
    (tmp_path / "e.pdf").write_text("unsupported")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for name, part, xml in (
        ("f.docx", "word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>'),
        ("g.odt", "content.xml", '<o xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:p>first <text:span>x</text:span></text:p><text:p>second</text:p></o>'),
    ):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr(part, xml)
        (tmp_path / name).write_bytes(data.getvalue())
    (tmp_path / "h.docx").write_text("damaged")
    got = {r.path.rpartition("/")[2]: r.text for r in readers.read_files(spark, [str(tmp_path)]).collect()}
    assert got == {"a.txt": "Grüße, Welt", "b.txt": "Größe", "f.docx": "one two\nthree", "g.odt": "first x\nsecond", "h.docx": None}


def test_tagged_words(spark, tmp_path):
    (tmp_path / "x.lempos").write_text("The_DT\ndog_barks_NN\n\n._.\n")
    rows = readers.read_tagged(spark, str(tmp_path / "x.lempos")).orderBy("pos").collect()
    assert [(r.lemma, r.tag) for r in rows] == [("the", "DT"), ("dog_barks", "NN"), (".", ".")]


def test_add_files(spark):
    asked = spark.createDataFrame([("a.txt", 3), ("a.txt", 3), ("b.pdf", 2), ("c.odt", 0), ("d.docx", 9)], "path string, size long")
    have = spark.createDataFrame([("d.docx",)], "path string")
    got = {r.path: r.status for r in files.add_files(asked, have).collect()}
    assert got == {"a.txt": "added", "b.pdf": "unsupported", "c.odt": "empty", "d.docx": "already added"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1 / 32, None)], "doc_id long, MLS double, W long")
    sinks.write_one(df, str(tmp_path / "o.json"), "json")
    assert json.loads((tmp_path / "o.json").read_text()) == [{"doc_id": "1", "MLS": "0.0312", "W": "None"}]
    m = spark.createDataFrame([(1, "C/S", 0, "a b"), (1, "C/S", 1, "c")], "doc_id long, measure string, ord int, match string")
    sinks.write_matches(m, str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m/doc=1/measure_name=C-per-S")).collect()] == ["a b", "c"]


def test_streams_give_the_batch_rows(spark, tmp_path):
    rows = [(i, "the dog runs. " * (i + 1)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.lexical_stream(source).writeStream.format("memory").queryName("lex").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(spark.table("lex")) == key(stream.lexical_stream(df))


def test_cli(capsys, tmp_path):
    cli.main(["sca", "--list"])
    assert len(capsys.readouterr().out.splitlines()) == 23
    cli.main(["lca", "--list"])
    assert len(capsys.readouterr().out.splitlines()) == 43


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "b.txt").write_text("The dog barks and the cat runs.")
    (tmp_path / "a.txt").write_text("The old dog ran home quickly.")
    (tmp_path / "t.trees").write_text("(ROOT (S (NP (DT the) (NN dog)) (VP (VBZ barks)) (. .)))")
    return tmp_path


def rows_of(path):
    with open(path, encoding="utf-8") as f:
        return list(csv.DictReader(f))


def test_cli_names_files_and_groups(spark, folder):
    cli.main(["sca", "b.txt", "a.txt", "-c", "b.txt", "a.txt", "-c", "a.txt", "b.txt", "--select", "W", "S", "-o", "o.csv"])
    rows = {r["Filepath"]: (r["W"], r["S"]) for r in rows_of("o.csv")}
    assert rows == {str(folder / "a.txt"): ("6", "1"), str(folder / "b.txt"): ("7", "1"), "b.txt+a.txt": ("13", "2"), "a.txt+b.txt": ("13", "2")}
    with pytest.raises(SystemExit):
        cli.main(["sca", "-c", "a.txt"])


def test_cli_combines_words_in_the_order_of_the_files(spark, folder):
    for first, second in (("a.txt", "b.txt"), ("b.txt", "a.txt")):
        cli.main(["lca", "-c", first, second, "-o", "l.csv"])
        r = rows_of("l.csv")[0]
        assert r["Filepath"] == f"{first}+{second}" and r["word_n"] == "13" and r["NDW-50"] == "10.0"


def test_cli_matches_and_bracketed_input(spark, folder, capsys):
    cli.main(["sca", "t.trees", "--no-parse", "-m", "-o", "x.json", "--select", "VP", "W"])
    assert json.loads((folder / "x.json").read_text())[0]["VP"] == "1"
    assert [r.value for r in spark.read.text(str(folder / "x_matches/doc=t.trees/measure_name=VP")).collect()] == ["barks"]
    cli.main(["sca", "--no-parse", "-t", "(ROOT (S (VP (VB go))))", "--stdout", "--select", "S"])
    assert capsys.readouterr().out.split() == ["Filepath,S", "cli_text,1"]
    cli.main(["lca", "-t", "the dog saw the dog", "-m", "-o", "w.csv"])
    got = {m: [r.value for r in spark.read.text(str(folder / f"w_matches/doc=cli_text/measure_name=noun_{m}")).collect()] for m in "tn"}
    assert got == {"t": ["dog", "saw"], "n": ["dog", "saw", "dog"]}


def test_cli_cache(spark, folder):
    cli.main(["sca", "a.txt", "b.txt", "--cache", "-o", "1.csv"])
    kept = cache.AnnotationCache(spark, str(folder / "lexforest-cache"), "sca")
    assert {r.path for r in kept.listing().collect()} == {str(folder / "a.txt"), str(folder / "b.txt")}
    kept.save(spark.createDataFrame([(str(folder / "a.txt"), "(ROOT (S (X y)))")], "path string, annotation string"))
    cli.main(["sca", "a.txt", "b.txt", "--use-cache", "-o", "2.csv", "--select", "W"])
    assert {r["Filepath"].rpartition("/")[2]: r["W"] for r in rows_of("2.csv")} == {"a.txt": "1", "b.txt": "7"}
    kept.delete(spark.createDataFrame([(str(folder / "a.txt"),)], "path string"))
    kept.compact()
    assert [r.path for r in kept.entries().collect()] == [str(folder / "b.txt")] and len(list((folder / "lexforest-cache/sca").iterdir())) == 1


def test_encodings():
    for text, name in (("Größe und Maß, naïve café", "cp1252"), ("Привет, мир и все слова", "cp1251"), ("zażółć gęślą jaźń", "cp1250"), ("他们知道我在这里工作。", "gb18030"), ("né", "utf-16"), ("né", "utf-8")):
        assert readers.decode(text.encode(name)) == text, name


def test_sums_have_the_matches_of_their_parts(spark):
    forest = "(ROOT (S (NP (PRP I)) (VP (VBP know))))\n(ROOT (SQ (MD can) (NP (PRP we))))"
    df = spark.createDataFrame([(1, forest)], "doc_id long, forest string")
    rows = sca.measure_matches(df, ["VP", "MLS", "W"]).orderBy("ord").collect()
    assert [(r.measure, r.ord, r.match) for r in rows] == [("VP", 0, "know"), ("VP", 1, "can")]
    assert sca.measure_matches(df, ["MLS"]).count() == 0
