"""Kept annotations of files: a folder of Parquet batches, of which the newest row of a path counts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import human_size
from .files import cache_lookup

SCHEMA = "path string, annotation string, cached_at timestamp"


class AnnotationCache:
    """Annotations (text: a forest, or tagged words) by path.

    A batch is written whole or not at all, so a run that ends half-way leaves no broken
    entry; a deletion is a batch of null annotations. ``compact`` drops what no longer counts.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{kind}"

    def entries(self) -> DataFrame:
        """path, annotation, cached_at and size of the newest row of each path; deleted and empty ones are left out."""
        try:
            rows = self.spark.read.option("recursiveFileLookup", "true").parquet(self.folder).select("path", "annotation", "cached_at")
        except AnalysisException:
            rows = self.spark.createDataFrame([], SCHEMA)
        last = rows.groupBy("path").agg(F.max_by(F.struct("annotation", "cached_at"), "cached_at").alias("last"))
        return last.select("path", "last.*").withColumn("size", F.coalesce(F.octet_length("annotation"), F.lit(0)).cast("long")).where("size > 0")

    def _append(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.folder}/batch-{uuid.uuid4().hex}")

    def save(self, annotated: DataFrame) -> None:
        """Registers annotations (path, annotation)."""
        self._append(annotated.select("path", "annotation", F.current_timestamp().alias("cached_at")))

    def lookup(self, files: DataFrame) -> DataFrame:
        """files (path, mtime, ...) whose annotation is newer than the file, with annotation."""
        have = self.entries()
        found = cache_lookup(files.drop("size", "annotation"), have).where("valid")
        return found.drop("valid", "cached_at", "size")

    def listing(self) -> DataFrame:
        """path, cached_at and readable size, as a list of the cache shows them."""
        return self.entries().select("path", "cached_at", human_size(F.col("size")).alias("size"))

    def delete(self, paths: DataFrame) -> None:
        """Forgets the paths (path)."""
        self._append(paths.select("path", F.lit(None).cast("string").alias("annotation"), F.current_timestamp().alias("cached_at")))

    def compact(self) -> None:
        """Rewrites the entries that count as one batch and drops the others, broken ones included."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = where.getFileSystem(conf)
        if not fs.exists(where):
            return
        old = [s.getPath() for s in fs.listStatus(where)]
        self._append(self.entries().select("path", "annotation", "cached_at"))
        for p in old:
            fs.delete(p, True)
