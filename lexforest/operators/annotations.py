"""Annotations by processor: one column a processor and document, added to as processors are.

A store is a folder of Parquet batches (doc_id, digest, value) and of manifests. A manifest names the batches that
count, by processor and version; the one with the largest number is the state. A run writes its batches first
and then puts the next manifest in place by one rename, so a run that ends half-way leaves the old state.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import file_system
from .files import missing_annotations
from .tokens import penn_tag_in_place, words


@dataclass(frozen=True)
class Processor:
    """A column over the documents' own columns and those of the processors that it needs.

    version: to be raised when compute changes. type: of the values, as Spark writes it.
    """

    name: str
    version: str
    compute: Callable[[], Column]
    type: str
    needs: tuple[str, ...] = field(default=())


class ConcurrentRunError(RuntimeError):
    pass


class AnnotationStore:
    """Annotations of documents (doc_id, text) by processor.

    An entry counts if its document's text and its processor's version, and those of the processors it needs, are
    what they were. A doc_id with several rows has an entry a different text. Documents without doc_id have none: their
    columns are computed each time. The manifest grows with the runs, not with the documents; ``compact`` shortens it.
    """

    def __init__(self, spark: SparkSession, folder: str, processors: list[Processor]):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.processors = {p.name: p for p in processors}
        for p in processors:
            self._order([p.name])

    # ---- processors

    def _order(self, names, above: tuple[str, ...] = ()) -> list[str]:
        """The names and what they need, each after what it needs."""
        out: list[str] = []
        for n in names:
            if n in above:
                raise ValueError(f"processors need each other: {' -> '.join([*above, n])}")
            if n not in self.processors:
                raise ValueError(f"no processor {n}")
            out += [*self._order(self.processors[n].needs, (*above, n)), n]
        return list(dict.fromkeys(out))

    def version(self, name: str) -> str:
        """Of a processor with all that it needs."""
        p = self.processors[name]
        return hashlib.sha256(json.dumps([p.name, p.version, p.type, *(self.version(n) for n in p.needs)]).encode()).hexdigest()[:16]

    # ---- manifests

    def _manifests(self) -> list[int]:
        fs, where = file_system(self.spark, f"{self.folder}/manifests")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self) -> tuple[int, dict[str, dict]]:
        """Number and content of the state: processor -> version and batches (folders below the store)."""
        known = self._manifests()
        if not known:
            return 0, {}
        text = self.spark.read.text(f"{self.folder}/manifests/{known[-1]}", wholetext=True).first()
        return known[-1], json.loads(text.value)

    def _swap(self, number: int, content: dict[str, dict]) -> None:
        """Puts content in place as the manifest of that number, or fails if another run was first."""
        fs, temporary = file_system(self.spark, f"{self.folder}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(temporary)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        _, where = file_system(self.spark, f"{self.folder}/manifests/{number}")
        if fs.exists(where) or not fs.rename(temporary, where):
            fs.delete(temporary, False)
            raise ConcurrentRunError(f"another run wrote state {number} of {self.folder}")

    # ---- entries

    def entries(self, name: str) -> DataFrame:
        """doc_id, digest and value that count for a processor; runs that met by chance may have written an entry twice."""
        kept = self.manifest()[1].get(name)
        schema = f"doc_id long, digest string, value {self.processors[name].type}"
        if kept is None or kept["version"] != self.version(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{b}" for b in kept["batches"]))

    def missing(self, documents: DataFrame, name: str) -> DataFrame:
        """Documents (with digest) that a processor has not annotated."""
        return missing_annotations(documents, self.entries(name), "doc_id", "digest")

    def _with(self, documents: DataFrame, names, given: Callable[[str, Column], Column]) -> DataFrame:
        for n in names:
            documents = documents.join(self.entries(n).select("doc_id", "digest", given(n, F.col("value")).alias(n)), ["doc_id", "digest"], "left")
        return documents

    def update(self, documents: DataFrame, names) -> dict[str, int]:
        """Annotates what is not annotated yet; how many entries each processor wrote.

        A processor reads the text and the columns that it needs of its missing documents only. State changes once, at the end.
        """
        # equal rows are one entry
        docs = digested(documents).where("doc_id IS NOT NULL").select("doc_id", "digest", "text").dropDuplicates(["doc_id", "digest"])
        number, state = self.manifest()
        state, written = dict(state), {}
        fresh: dict[str, DataFrame] = {}
        for n in self._order(names):
            p = self.processors[n]
            # by keys alone at first, so that texts are not moved where nothing is missing
            if self.missing(docs.select("doc_id", "digest"), n).isEmpty():
                written[n] = 0
                continue
            todo = self.missing(docs, n)
            for need in p.needs:
                have = self.entries(need)
                have = have.unionByName(fresh[need]) if need in fresh else have
                todo = todo.join(have.withColumnRenamed("value", need), ["doc_id", "digest"], "left")
            batch = f"batches/{n}-{uuid.uuid4().hex}"
            todo.select("doc_id", "digest", p.compute().cast(p.type).alias("value")).write.parquet(f"{self.folder}/{batch}")
            rows = self.spark.read.schema(f"doc_id long, digest string, value {p.type}").parquet(f"{self.folder}/{batch}")
            written[n] = rows.count()
            if not written[n]:
                fs, where = file_system(self.spark, f"{self.folder}/{batch}")
                fs.delete(where, True)
                continue
            fresh[n] = rows
            old = state.get(n, {})
            batches = old["batches"] if old.get("version") == self.version(n) else []
            state[n] = {"version": self.version(n), "batches": [*batches, batch]}
        if fresh:
            self._swap(number + 1, state)
        return written

    def annotate(self, documents: DataFrame, names, of: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
        """documents with a column a name; what is not there yet is computed and kept.

        of: for some of the names, what is given of the value. It is taken where entries lie, so that only this is joined.
        """
        self.update(documents, names)
        known = digested(documents)
        given = lambda n, value: (of or {}).get(n, lambda x: x)(value)
        out = self._with(known.where("doc_id IS NOT NULL"), names, given)
        nameless = known.where("doc_id IS NULL")
        for n in self._order(names):
            nameless = nameless.withColumn(n, self.processors[n].compute().cast(self.processors[n].type))
        nameless = nameless.withColumns({n: given(n, F.col(n)) for n in names})
        return out.unionByName(nameless.select(out.columns)).select(*documents.columns, *names)

    def compact(self) -> None:
        """Rewrites the entries that count as one batch a processor; then drops old manifests and batches without one.

        No other run may be under way, for its batches have no manifest yet.
        """
        number, state = self.manifest()
        kept = {}
        for n, p in self.processors.items():
            if n in state and state[n]["version"] == self.version(n):
                batch = f"batches/{n}-{uuid.uuid4().hex}"
                self.entries(n).dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", F.col("value").cast(p.type).alias("value")).write.parquet(f"{self.folder}/{batch}")
                kept[n] = {"version": state[n]["version"], "batches": [batch]}
        if not state:
            return
        self._swap(number + 1, kept)
        stay = {b.split("/")[1] for k in kept.values() for b in k["batches"]} | {str(number + 1)}
        for part in ("batches", "manifests"):
            fs, where = file_system(self.spark, f"{self.folder}/{part}")
            for s in fs.listStatus(where):
                if s.getPath().getName() not in stay:
                    fs.delete(s.getPath(), True)


def digested(documents: DataFrame) -> DataFrame:
    """documents with digest, by which a changed text is told; that of null is empty."""
    return documents.withColumn("digest", F.coalesce(F.sha2("text", 256), F.lit("")))


#: The rule annotator as processors: words, and their Penn tags.
WORDS = Processor("lemmas", "1", lambda: words(F.col("text")), "array<string>")
TAGS = Processor("tags", "1", lambda: F.expr(f"transform(lemmas, w -> {penn_tag_in_place('w')})"), "array<string>", ("lemmas",))
