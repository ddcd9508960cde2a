"""A bitmap of hashes, to thin a large table before an exact join (DataFrame functions only).

It has ``PER_KEY`` bits a key or more, up to 2^MOST bits, so that it can be
broadcast; where more keys come, ``Bitmap.thin`` leaves the rows as they are and
the exact join that follows does the whole work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bits of the smallest and the largest bitmap: 2^26 bits are at most 1,048,576 words of 64 bits.
FEWEST, MOST, PER_KEY = 16, 26, 8


def _word(s: Column) -> Column:
    return F.shiftright(s, 6)


def _bit(s: Column) -> Column:
    return s.bitwiseAND(63).cast("int")


class Bitmap:
    """A bitmap of the keys in a column of a written table."""

    def __init__(self, scratch: Scratch, keys: DataFrame, key: str):
        n = max(1, keys.count())
        self.bits = max(FEWEST, (n * PER_KEY - 1).bit_length())
        self.words = None
        if self.bits <= MOST:
            at = keys.select(self._slot(key).alias("s"))
            one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("s")))
            self.words = scratch.save(at.groupBy(_word(F.col("s")).alias("__word")).agg(F.bit_or(one).alias("__bits")))

    def _slot(self, key: str) -> Column:
        return F.xxhash64(F.lit(3), F.col(key)).bitwiseAND((1 << self.bits) - 1)

    def thin(self, rows: DataFrame, key: str) -> DataFrame:
        """rows without most of those whose key is not in the bitmap; none whose key is in it is lost.

        Follow it with an inner join: Spark moves a semi join below this one.
        """
        if self.words is None:
            return rows
        s = rows.withColumn("__slot", self._slot(key)).withColumn("__word", _word(F.col("__slot")))
        on = F.call_function("shiftright", F.col("__bits"), _bit(F.col("__slot"))).bitwiseAND(1) == 1
        # at most 2^MOST / 64 rows
        return s.join(F.broadcast(self.words), "__word").where(on).drop("__slot", "__word", "__bits")
