"""Whether two strings are within a few edits: a banded bit-parallel edit distance in DataFrame functions.

The strings lose their common start and end; what is left goes through a column
of the distance matrix a character, of which words of 32 bits (in longs, so that
sums don't overflow) hold the vertical differences inside the band, as plus and
minus bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Bits of a word; the band takes the highest 2 * edits + 1.
WORD_BITS = 32
_MASK = (1 << WORD_BITS) - 1


def _let(value: Column, f) -> Column:
    """f(value), with value computed once inside a lambda function."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _shl(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def _shr(x: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, n)


def shared_start(a: Column, b: Column) -> Column:
    """Length of the common start, by halving steps."""
    shorter = F.least(F.char_length(a), F.char_length(b))
    powers = F.reverse(F.sequence(F.lit(0), F.floor(F.log2(shorter + 1)).cast("int")))

    def step(at: Column, power: Column) -> Column:
        more = _shl(F.lit(1), power)
        same = F.substring(a, at + 1, more) == F.substring(b, at + 1, more)
        return F.when((at + more <= shorter) & same, at + more).otherwise(at)

    return F.aggregate(powers, F.lit(0), step)


def _distance(long: Column, short: Column, most: int) -> Column:
    """Edit distance of arrays of characters if it is at most ``most``, else a larger number.

    long has more than ``most`` characters, and short as many less at most.
    """
    n = F.size(long)
    top, zero = WORD_BITS - 1, F.lit(0).cast("long")
    flipped = lambda x: x.bitwiseXOR(_MASK)

    def column(state: Column, c: Column) -> Column:
        i, vp, vn, d = state["i"], state["vp"], state["vn"], state["d"]
        hit = zero
        for k in range(-most, most + 1):
            hit = hit.bitwiseOR(F.when(F.get(long, i + k) == c, F.lit(1 << (top - most + k)).cast("long")).otherwise(zero))

        def update(x: Column) -> Column:
            same = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(_MASK)
            return _let(same, lambda d0: following(d0))

        def following(d0: Column) -> Column:
            return _let(vn.bitwiseOR(flipped(d0.bitwiseOR(vp))), lambda hp: state_of(d0, hp))

        def state_of(d0: Column, hp: Column) -> Column:
            hn, down = d0.bitwiseAND(vp), _shr(d0, F.lit(1))
            # down the lowest diagonal of the band, then along the last row
            at = F.lit(top - 1 - most) + n - i
            along = _shr(hp, at).bitwiseAND(1).cast("int") - _shr(hn, at).bitwiseAND(1).cast("int")
            more = F.when(i < n - most, F.when(d0 >= (1 << top), 0).otherwise(1)).otherwise(along)
            return F.struct((i + 1).alias("i"), hn.bitwiseOR(flipped(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (d + more).alias("d"))

        return _let(hit, update)

    start = F.struct(F.lit(0).alias("i"), F.lit(((1 << (most + 1)) - 1) << (top - most)).cast("long").alias("vp"), zero.alias("vn"), F.lit(most).alias("d"))
    return F.aggregate(short, start, column)["d"]


def _trimmed(x: Column, y: Column, f) -> Column:
    """f of the reversed rest of x and y without their common start."""
    rest = lambda c, n: F.reverse(F.substring(c, n + 1, F.char_length(c)))
    return _let(shared_start(x, y), lambda n: _let(F.struct(rest(x, n).alias("x"), rest(y, n).alias("y")), lambda s: f(s["x"], s["y"])))


def _same_inside(x: Column, y: Column) -> Column:
    """What holds of strings two edits apart at most whose first and last characters differ: an edit stands at either end, and all between is equal."""
    edit = ((1, 1), (1, 0), (0, 1))  # characters that it takes of x and of y
    part = lambda c, i, j: F.substring(c, F.lit(i + 1), F.char_length(c) - i - j)
    found = F.lit(False)
    for i, k in edit:
        for j, m in edit:
            found = found | (part(x, i, j) == part(y, k, m))
    return found


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are at most so many edits apart (characters are code points)."""
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))

    def rest(x: Column, y: Column) -> Column:
        near = _let(F.struct(chars(x).alias("x"), chars(y).alias("y")), lambda s: _distance(s["x"], s["y"], edits) <= edits)
        return F.when(F.char_length(x) <= edits, True).when(F.lit(edits == 0), False).when(F.lit(edits <= 2) & ~_same_inside(x, y), False).otherwise(near)

    first = F.char_length(a) >= F.char_length(b)
    both = F.struct(F.when(first, a).otherwise(b).alias("x"), F.when(first, b).otherwise(a).alias("y"))
    near = _let(both, lambda s: _trimmed(s["x"], s["y"], lambda x, y: _trimmed(x, y, rest)))
    return (F.abs(F.char_length(a) - F.char_length(b)) <= edits) & near
