"""Documents from files: plain text, word-processor files, bracketed forests and tagged words.

Spark lists and reads the files; the unpacking of word-processor files is a
small helper inside an Arrow function.
"""

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..operators.files import SUFFIXES, suffix
from .charsets import decode

# Parts and tags of the two word-processor formats.
DOCX_PART, DOCX_P, DOCX_T = "word/document.xml", "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}p", "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}t"
ODT_PART, ODT_P = "content.xml", "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}p"


def unpack(content: bytes, kind: str) -> str | None:
    """Paragraphs of a docx or odt file, a line each; null if the file is damaged."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ET.fromstring(z.read(DOCX_PART if kind == "docx" else ODT_PART))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None
    if kind == "docx":
        return "\n".join("".join(t.text or "" for t in p.iter(DOCX_T)) for p in root.iter(DOCX_P))
    return "\n".join("".join(p.itertext()) for p in root.iter(ODT_P))


def _texts(content: pa.Array, kind: pa.Array) -> pa.Array:
    return pa.array([unpack(c, k) if k in ("docx", "odt") else decode(c) for c, k in zip(content.to_pylist(), kind.to_pylist(), strict=True)], pa.string())


def text_of(content: str, kind: str):
    """Column of the text of file contents; the function needs a session, so it is made when asked for."""
    return arrow_udf(_texts, "string")(content, kind)


def local_path(path: str) -> str:
    """A path as read_files gives it: absolute, and without a scheme if it is local."""
    return path if "://" in path else os.path.abspath(path.removeprefix("file:"))


def plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def read_files(spark: SparkSession, paths: list[str], recursive: bool = False, suffixes=SUFFIXES) -> DataFrame:
    """doc_id, path, mtime, size and text of the supported files; names that start with . or ~$ are left out.

    Other kinds of files are left out by their names, before any is read. suffixes: None takes all files as plain text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffixes is not None:
        either = lambda s: "".join(f"[{c.lower()}{c.upper()}]" for c in s)
        files = files.option("pathGlobFilter", "*.{%s}" % ",".join(either(s) for s in suffixes))
    files = files.load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lit("txt") if suffixes is None else suffix(F.col("path"))
    files = files.where(~name.startswith(".") & ~name.startswith("~$")).withColumn("kind", kind)
    return files.select(F.xxhash64("path").alias("doc_id"), plain(F.col("path")).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), text_of("content", "kind").alias("text"))


def inline_text(spark: SparkSession, text: str, name: str = "cli_text") -> DataFrame:
    return spark.createDataFrame([(0, name, text)], "doc_id long, path string, text string")


def read_forests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path and forest of files that hold bracketed trees."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("forest"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "forest")


def tagged_words(texts: DataFrame, column: str) -> DataFrame:
    """doc_id, pos, lemma and tag of texts of one lemma_TAG a line."""
    lines = texts.select("doc_id", F.posexplode(F.filter(F.split(column, r"\r?\n"), lambda x: x != "")).alias("pos", "line"))
    cut = r"^(.*)_([^_]*)$"
    return lines.select("doc_id", "pos", F.lower(F.regexp_extract("line", cut, 1)).alias("lemma"), F.regexp_extract("line", cut, 2).alias("tag"))


def tagged_text(pos: str, lemma: str, tag: str) -> Column:
    """Aggregate: a document's words, one lemma_TAG a line in order."""
    rows = F.array_sort(F.collect_list(F.struct(pos, F.concat_ws("_", lemma, tag).alias("w"))))
    return F.array_join(F.transform(rows, lambda x: x["w"]), "\n")


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, pos, lemma and tag from files of one lemma_TAG a line."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("t"))
    return tagged_words(whole.select(F.xxhash64("path").alias("doc_id"), "t"), "t")
