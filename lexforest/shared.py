"""What queries share: a folder that the driver and all executors see, and tables dealt out by the size of their input."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input files a task, where words or tree nodes are spelled out of them: these are some hundred times as large in memory.
PIECE = 1 << 20


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, removed at exit; a local session without that setting has one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexforest-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def tidy():
        try:
            fs, where = file_system(spark, path)
            fs.delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass

    atexit.register(tidy)
    return path


def dealt(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows by the hash of the key, in as many parts as the files that they come from ask for.

    Spark would join parts by the size of the texts that it shuffles, long before they are spelled out.
    """
    spark = rows.sparkSession
    size = 0
    for path in rows.inputFiles():
        fs, where = file_system(spark, path)
        size += fs.getFileStatus(where).getLen()
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-size // PIECE)), key)
