"""Command line: ``python -m lexforest.cli {sca,lca} files...``"""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from . import __version__
from .operators.files import SUFFIXES


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexforest")
    top.add_argument("--version", action="version", version=f"lexforest {__version__}")
    sub = top.add_subparsers(dest="what", required=True)
    for name in ("sca", "lca"):
        p = sub.add_parser(name)
        p.add_argument("paths", nargs="*", help="files or folders, each file a row of the result")
        p.add_argument("--list", action="store_true", help="list the measures")
        p.add_argument("-t", "--text", help="analyse this text")
        p.add_argument("-c", "--combine-files", nargs="+", action="append", default=[], metavar="FILE", help="analyse these files as one; may be given several times")
        p.add_argument("--ftype", nargs="+", choices=SUFFIXES, default=SUFFIXES, help="kinds of files to read")
        p.add_argument("-o", "--output")
        p.add_argument("--output-format", choices=("csv", "json", "tsv"), default="csv")
        p.add_argument("--stdout", action="store_true", help="print the result instead of writing a file")
        p.add_argument("-m", "--save-matches", action="store_true", help="write the matches to a folder named after the output")
        p.add_argument("--cache", action="store_true", help="keep the annotations of files")
        p.add_argument("--use-cache", action="store_true", help="use kept annotations that are newer than their files")
        p.add_argument("--cache-folder", default="lexforest-cache")
        loud = p.add_mutually_exclusive_group()
        loud.add_argument("--quiet", dest="level", action="store_const", const=logging.CRITICAL, default=logging.WARNING)
        loud.add_argument("--verbose", dest="level", action="store_const", const=logging.INFO)
    sub.choices["sca"].add_argument("--select", nargs="+")
    sub.choices["sca"].add_argument("--no-parse", action="store_true", help="the input holds bracketed trees")
    sub.choices["sca"].add_argument("--definitions", help="JSON file of measures of one's own")
    sub.choices["lca"].add_argument("--tagset", choices=("ud", "ptb"), default="ud")
    sub.choices["lca"].add_argument("--tagged", action="store_true", help="the input holds one lemma_TAG a line")
    sub.choices["lca"].add_argument("--wordlist", help="table of lemma, freq, ins_ord; default: the input's own frequencies")
    sub.choices["lca"].add_argument("--adjectives", help="table of lemma; default: the words tagged as adjectives")
    return top


def kind_of(args) -> str:
    """The output's extension wins over --output-format; an unknown one is refused."""
    if args.output and (ext := Path(args.output).suffix.lstrip(".")):
        if ext not in ("csv", "json", "tsv"):
            raise SystemExit(f"unknown output format: {ext}")
        return ext
    return args.output_format


def definitions_of(path: str | None) -> list[dict] | None:
    """Measures of one's own from a JSON file with an array named structures."""
    import json

    if path is None:
        return None
    if not path.endswith(".json") or not Path(path).is_file():
        raise SystemExit(f"no JSON file: {path}")
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as error:
        raise SystemExit(f"{path}: {error}") from error
    if not isinstance(found, dict) or not isinstance(found.get("structures"), list):
        raise SystemExit(f"{path} needs an array named structures")
    return found["structures"]


def descriptions(what: str) -> list[tuple[str, str]]:
    from .operators import lexical, measures

    if what == "sca":
        return [(m.name, m.description) for m in measures.BUILT_IN]
    counted = [(f"{c}{x}", f"number of {lexical.CLASS_NAMES[c]} ({'distinct words' if x == 'types' else 'tokens'})") for x in ("types", "tokens") for c in lexical.CLASSES]
    return counted + list(lexical.DESCRIPTIONS.items())


class Input:
    """The documents of a call: docs (doc_id, path, mtime, text), and groups (doc_id, group_id, ord) of those to combine."""

    def __init__(self, spark, args, suffixes):
        from pyspark.sql import functions as F

        from .operators import combine
        from .sources import readers

        self.groups = None
        if args.text is not None:
            self.docs = readers.inline_text(spark, args.text).withColumn("mtime", F.lit(None).cast("timestamp"))
            return
        several = [p for group in args.combine_files for p in group]
        self.docs = readers.read_files(spark, [readers.local_path(p) for p in (*args.paths, *several)], suffixes=suffixes).dropDuplicates(["path"])
        if args.combine_files:
            rows = [("+".join(group), i, readers.local_path(p)) for group in args.combine_files for i, p in enumerate(group)]
            asked = spark.createDataFrame(rows, "group_id string, ord int, path string")
            self.groups = asked.join(self.docs.select("doc_id", "path"), "path").select("doc_id", "group_id", "ord")
            refused = [r.group_id for r in combine.check_groups(asked).collect()]
            if refused:
                raise SystemExit(f"a group needs two files or more: {', '.join(refused)}")
        # files of groups are not reported alone, unless they are named alone, too
        alone = [readers.local_path(p).rstrip("/") for p in args.paths]
        keep = F.lit(False)
        for p in alone:
            keep = keep | (F.col("path") == p) | F.col("path").startswith(p + "/")
        self.single = self.docs.where(keep) if args.paths else self.docs.limit(0)

    def named(self, out, key="doc_id"):
        """out with the file's path, or the group's members, as the first column Filepath."""
        from pyspark.sql import functions as F

        if key == "group_id":
            return out.select(F.col("group_id").alias("Filepath"), *(F.col(f"`{c}`") for c in out.columns if c != "group_id"))
        both = self.docs.select("doc_id", F.col("path").alias("Filepath")).join(out, "doc_id")
        return both.select("Filepath", *(F.col(f"`{c}`") for c in out.columns if c != "doc_id")).orderBy("Filepath")


def annotated(spark, args, docs, annotate):
    """docs with the column annotation, from the cache where it is asked for and valid."""
    from .operators.cache import AnnotationCache
    from .operators.files import missing_annotations
    from .sources.readers import local_path

    if not (args.cache or args.use_cache) or args.text is not None:
        return annotate(docs)
    cache = AnnotationCache(spark, local_path(args.cache_folder), args.what)
    fresh = cache.lookup(docs) if args.use_cache else docs.limit(0).select("doc_id").selectExpr("*", "'' AS annotation")
    made = annotate(missing_annotations(docs, fresh))
    if args.cache:
        cache.save(made.join(docs.select("doc_id", "path"), "doc_id"))
    return made.select("doc_id", "annotation").unionByName(fresh.select("doc_id", "annotation"))


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from . import sinks
    from .operators import lexical
    from .operators.surrogate import surrogate_forests
    from .operators.tokens import lemmas, with_tags
    from .plans import lca, sca
    from .sources import readers

    args = parser().parse_args(argv)
    logging.basicConfig()
    logging.getLogger("lexforest").setLevel(args.level)
    kind = kind_of(args)
    if args.list:
        print("\n".join(f"{n}: {d}" for n, d in descriptions(args.what)))
        return
    if not args.paths and not args.combine_files and args.text is None:
        raise SystemExit("no input")
    spark = SparkSession.builder.appName("lexforest").getOrCreate()
    written = args.output or f"lexforest_{args.what}_results.{kind}"
    to = None if args.stdout else written
    given = args.what == "sca" and args.no_parse or args.what == "lca" and args.tagged
    if given:
        args.cache = args.use_cache = False
    source = Input(spark, args, None if given else args.ftype)
    results = []
    if args.what == "sca":
        definitions = definitions_of(args.definitions)
        make = lambda d: surrogate_forests(d).withColumnRenamed("forest", "annotation")
        forests = source.docs.select("doc_id", F.col("text").alias("forest")) if given else annotated(spark, args, source.docs, make).withColumnRenamed("annotation", "forest")
        if args.text is not None or args.paths:
            own = forests if args.text is not None else forests.join(source.single.select("doc_id"), "doc_id", "left_semi")
            results.append(source.named(sca.analyse(own, args.select, definitions)))
        if source.groups is not None:
            results.append(source.named(sca.combined(forests, source.groups, args.select, definitions), "group_id"))
        found = sca.measure_matches(forests, args.select, definitions) if args.save_matches else None
    else:
        make = lambda d: with_tags(lemmas(d), args.tagset).groupBy("doc_id").agg(readers.tagged_text("pos", "lemma", "tag").alias("annotation"))
        texts = source.docs.select("doc_id", F.col("text").alias("annotation")) if given else annotated(spark, args, source.docs, make)
        toks = readers.tagged_words(texts, "annotation")
        frequencies = spark.read.load(args.wordlist) if args.wordlist else lexical.corpus_frequencies(toks)
        adjectives = spark.read.load(args.adjectives) if args.adjectives else toks.where(F.col("tag").isin("ADJ", "JJ")).select("lemma").distinct()
        if args.text is not None or args.paths:
            own = toks if args.text is not None else toks.join(source.single.select("doc_id"), "doc_id", "left_semi")
            results.append(source.named(lca.analyse(own, frequencies, adjectives, args.tagset)))
        if source.groups is not None:
            results.append(source.named(lca.combined(toks, source.groups, frequencies, adjectives, tagset=args.tagset), "group_id"))
        found = lca.matches(toks, frequencies, adjectives, args.tagset) if args.save_matches else None
    out = results[0] if len(results) == 1 else results[0].unionByName(results[1])
    sinks.write_one(out, to, kind)
    if found is not None:
        named = found.join(source.docs.select("doc_id", F.col("path").alias("file")), "doc_id").withColumn("doc_id", F.regexp_extract("file", "([^/]+)$", 1)).drop("file")
        sinks.write_matches(named, readers.local_path(str(Path(written).with_suffix("")) + "_matches"))


if __name__ == "__main__":
    main()
