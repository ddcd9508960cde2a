"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+``: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _root(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, removed at exit."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="lexforest-")
        _roots[app] = f"{shared.rstrip('/')}/lexforest-{uuid.uuid4().hex}"

        def tidy(path=_roots[app]):
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the JVM may be gone at exit
                pass

        atexit.register(tidy)
    return _roots[app]


class Scratch:
    """Intermediate tables written once to the shared folder.

    A written table cuts lineage: stages after it restart from the files when
    an executor is lost. ``drop`` removes tables that nothing lazy still reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            _delete(self.spark, df._scratch_path)


def numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """docs with __row, a number of the row that is the same at each reading, however Spark cuts the files.

    It is the number of the file (in the order of the paths) and the row's place in it, if
    docs are rows read from files, chosen or filtered but not multiplied. Other
    rows are written once with their numbers. A column __row of docs is replaced.
    """
    docs = docs.drop("__row")
    own = [F.col(f"`{c}`") for c in docs.columns]
    try:
        at = docs.select(*own, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    except AnalysisException:
        return scratch.save(docs.withColumn("__row", F.monotonically_increasing_id()))
    # a row a file, no more than the driver lists to plan the scan
    files = at.select("__file").distinct().select("__file", (F.row_number().over(Window.orderBy("__file")) - 1).cast("long").alias("__n"))
    number = F.call_function("shiftleft", F.col("__n"), F.lit(40)) + F.col("__index")
    return at.join(F.broadcast(scratch.save(files)), "__file").select(*own, number.alias("__row"))


def as_documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id (bigint), text (string) and the named columns, others dropped."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def slices(column, limit: int = 4 << 20, rows: int = 2048):
    """(first, last) row ranges of an Arrow string column of at most about limit bytes and at most so many rows."""
    sizes = string_sizes(column)
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and (total + n > limit or i - first >= rows):
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def string_sizes(column) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 buffer, n + 1 offsets) of an Arrow string array; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pa.array([x if x is not None else b"" for x in column.to_pylist()], pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 2 + 1))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(buf: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of concatenated texts (runs of bytes that are not space): starts, ends, text index of each, and a 64-bit hash of its bytes."""
    n = len(buf)
    inside = ~space[buf]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = off[1:-1]
    before[cut[cut < n]] = False  # a text's first byte starts a word
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    cut = cut[cut > 0] - 1
    after[cut[cut < n]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(off, starts, side="right") - 1
    if not len(starts):
        return starts, ends, doc, np.zeros(0, np.uint64)
    lens = ends - starts
    # sum of byte code times a random odd weight of its place in the word
    place = np.arange(n, dtype=np.int64)
    mark = np.zeros(n, np.int64)
    mark[starts] = starts - np.concatenate([[0], starts[:-1]])
    place -= np.cumsum(mark)
    place[place < 0] = 0
    weight = stream64(int(lens.max()) + 1, 11) | np.uint64(1)
    np.minimum(place, len(weight) - 1, out=place)
    code = stream64(256, 12)
    value = np.where(inside, code[buf] * weight[place], np.uint64(0))
    h = np.add.reduceat(value, starts)
    return starts, ends, doc, mix64(h + lens.astype(np.uint64))
