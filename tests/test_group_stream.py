"""Groups from a stream: pieces, restarts, members sent again, groups without a size, late members."""

import datetime
import os

import pytest
from lexforest import queries
from lexforest.streaming import groups
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "group_id string, doc_id long, text string, declared long, arrived timestamp"


@pytest.fixture(autouse=True)
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Feed:
    """A folder that a stream reads, one file a batch."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.n = spark, folder, options, 0
        os.makedirs(f"{folder}/in")

    def send(self, df):
        df.select(SCHEMA_NAMES).coalesce(1).write.mode("append").parquet(f"{self.folder}/in/{self.n}")
        self.n += 1

    def run(self):
        """Reads the files not read yet, oldest first, one a batch."""
        source = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")
        query = groups.start(source, f"{self.folder}/out", f"{self.folder}/check", parts=3, **self.options)
        query.awaitTermination()
        assert query.exception() is None

    def rows(self):
        return {(r.group_id, r.revision, r.members, r.lemma): r.n for r in self.spark.read.schema(groups.TYPES).parquet(f"{self.folder}/out").collect()}


SCHEMA_NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_a_stream_in_pieces_gives_the_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = docs.groupBy("source").agg(F.count("*").alias("declared"))
    members = docs.join(sizes, "source").select(F.concat(F.lit("g-"), "source").alias("group_id"), "doc_id", "text", "declared", F.lit(at(0)).alias("arrived"))
    feed = Feed(spark, str(tmp_path))
    for k in range(3):  # each run ends and starts the query anew, from its checkpoint
        feed.send(members.where(F.col("doc_id") % 3 == k).union(members.where(F.col("doc_id") % 3 == 0).limit(5)))
        feed.run()
    _, classes = queries.words_and_classes(spark, SF)
    batch = queries.lca_combine(spark, SF)
    got = groups.group_counts(groups.given_out(spark, f"{tmp_path}/out"), classes).select(batch.columns)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(got) == key(batch) and got.count() > 1


def test_gaps_and_late_members(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), gap=600, keep=7200, again="1 minute")
    df = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    for piece in (
        # a waits for its gap, b for its second member, e has no words; rows without group or document
        df(("a", 1, "one two one", None, at(0)), ("b", 5, "x", 2, at(0)), ("e", 7, None, 1, at(0)), (None, 8, "none", 1, at(0)), ("a", None, "none", 1, at(0))),
        df(("b", 6, "X y", 2, at(5)), ("a", 1, "one two one", None, at(0))),  # a member sent again
        df(("c", 9, "z", 3, at(30))),
        df(("c", 10, "z", 3, at(31))),
        df(("a", 2, "two three", None, at(32))),  # late: the group is given out anew
        df(("d", 11, "w", 5, at(1000))),
        df(("d", 12, "w", 5, at(1001))),
        df(("a", 3, "four", 1, at(1002))),  # forgotten by now: the name begins a new group
    ):
        feed.send(piece)
    feed.run()
    rows = feed.rows()
    assert {k: n for k, n in rows.items() if k[0] == "b"} == {("b", 1, 2, "x"): 2, ("b", 1, 2, "y"): 1}
    first = {("a", 1, 1, "one"): 2, ("a", 1, 1, "two"): 1}
    second = {("a", 2, 2, "one"): 2, ("a", 2, 2, "two"): 2, ("a", 2, 2, "three"): 1}
    assert {k: n for k, n in rows.items() if k[0] == "a"} == first | second | {("a", 1, 1, "four"): 1}
    assert rows[("c", 1, 2, "z")] == 2 and not [k for k in rows if k[0] in ("e", "d") or k[3] == "none"]
