"""Groups of documents whose members arrive apart: words by type as keyed state, given out when the group is whole.

The clock of the stream is the time at which a member arrived, so no member is behind the watermark;
a member is late if its group was given out before. The words of a group are dealt over a fixed number of keys by
their hash, so a group that holds a third of all documents is the state of many tasks, and a key holds
one row a type in the state store, not an array.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import lexical
from ..operators.tokens import words

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TYPES = "group_id string, part int, revision long, members long, lemma string, n long"
BLOCK = 8192


class GroupTypes(StatefulProcessor):
    """State of one key (group_id, part): members met, revisions given out, and tokens by lemma.

    The key is given out once its declared number of members is there or none arrived for ``gap``; a later member gives
    another revision, which holds all types anew; ``keep`` after the last one the key is forgotten.
    """

    def __init__(self, gap: int, keep: int):
        self.gap, self.keep = gap, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.types = handle.getMapState("types", "lemma string", "n long")
        self.group = handle.getValueState("group", "members long, revision long, timer long")

    def _set(self, members: int, revision: int, before: int | None, timer: int) -> None:
        if before is not None and before != timer:
            self.handle.deleteTimer(before)
        if before != timer:
            self.handle.registerTimer(timer)
        self.group.update((members, revision, timer))

    def _rows(self, key, members: int, revision: int) -> Iterator[pd.DataFrame]:
        block: list[tuple] = []
        for (lemma,), (n,) in self.types.iterator():
            block.append((key[0], key[1], revision, members, lemma, n))
            if len(block) == BLOCK:
                yield self._frame(block)
                block = []
        if block:
            yield self._frame(block)

    @staticmethod
    def _frame(block: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(block, columns=["group_id", "part", "revision", "members", "lemma", "n"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived, last, declared, added = 0, 0, 0, Counter()
        for frame in rows:
            arrived += len(frame)
            last = max(last, int(frame["at"].max()))
            declared = max(declared, int(frame["declared"].max()))
            for own in frame["words"]:
                added.update(own)
        members, revision, timer = self.group.get() if self.group.exists() else (0, 0, None)
        for lemma, n in added.items():
            old = self.types.getValue((lemma,)) if members else None
            self.types.updateValue((lemma,), (n + (old[0] if old else 0),))
        members += arrived
        if revision == 0 and not 0 < declared <= members:
            self._set(members, 0, timer, last + self.gap)
            return
        self._set(members, revision + 1, timer, last + self.keep)
        yield from self._rows(key, members, revision + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.group.exists():
            return
        now = expiredTimerInfo.getExpiryTimeInMs()
        members, revision, timer = self.group.get()
        if timer != now:
            return
        if revision:
            self.types.clear()
            self.group.clear()
            return
        # a timer that has fired is gone by itself
        self._set(members, 1, None, now + self.keep)
        yield from self._rows(key, members, 1)


def group_types(members: DataFrame, gap: int = 3600, keep: int = 86400, parts: int = 32, again: str = "1 hour") -> DataFrame:
    """Stream of TYPES from a stream of members (group_id, doc_id, text, declared, arrived).

    declared: how many members the group has, null or 0 if not known; then it is given out when none arrived for gap seconds.
    A member that is sent again within ``again`` counts once. Rows without group or doc_id belong to no group; a null or
    empty text is a member without words. Groups without words give no rows. keep: seconds for which late members
    revise a group; after that the name begins a new group. Needs the RocksDB state store (see ``start``).
    """
    known = members.where("group_id IS NOT NULL AND doc_id IS NOT NULL").withWatermark("arrived", again).dropDuplicatesWithinWatermark(["group_id", "doc_id"])
    dealt = F.transform(words(F.col("text")), lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(parts)).cast("int").alias("p"), w.alias("w")))
    rows = known.select("arrived", F.col("group_id").cast("string").alias("group_id"), F.coalesce(F.col("declared").cast("long"), F.lit(0)).alias("declared"), dealt.alias("dealt"))
    # every key hears of every member, so all keys of a group agree on when it is whole
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    own = F.transform(F.filter("dealt", lambda x: x["p"] == F.col("part")), lambda x: x["w"])
    rows = rows.select("arrived", F.unix_millis("arrived").alias("at"), "group_id", "part", "declared", own.alias("words"))
    return rows.groupBy("group_id", "part").transformWithStateInPandas(GroupTypes(gap * 1000, keep * 1000), TYPES, "Append", "EventTime")


def start(members: DataFrame, out: str, checkpoint: str, available: bool = True, **options) -> StreamingQuery:
    """Starts the stream of ``group_types`` into Parquet files at out; with available it ends when all that is there was read.

    A query that is started again with its checkpoint goes on where it was: both folders must be shared by all executors.
    """
    spark = members.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        sink = group_types(members, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        return (sink.trigger(availableNow=True) if available else sink).start()
    finally:
        spark.conf.set(STORE, before)


def given_out(spark: SparkSession, out: str) -> DataFrame:
    """group_id, members, lemma and n of each group's last revision in what a stream wrote."""
    rows = spark.read.schema(TYPES).parquet(out)
    last = rows.groupBy("group_id").agg(F.max("revision").alias("revision"))
    return rows.join(last, ["group_id", "revision"]).select("group_id", "members", "lemma", "n")


def group_counts(types: DataFrame, classes: DataFrame) -> DataFrame:
    """group_id and the eighteen counts of groups given out; classes: lemma, class and soph."""
    return lexical.counts(types.join(classes, "lemma"), "group_id", once=True)
