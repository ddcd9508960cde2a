"""Scalar helpers as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def safe_log(n: Column, base: float | None = None) -> Column:
    """Logarithm (natural without base), 0 where n is not positive."""
    log = F.ln(n.cast("double")) if base is None else F.log10(n.cast("double")) if base == 10 else F.log(float(base), n.cast("double"))
    return F.when(n > 0, log).otherwise(0.0)


def chunk_of(position: Column, size: int) -> Column:
    """Number of the chunk of fixed size that a position from 0 lies in."""
    return F.floor(position / size)


def human_size(n: Column) -> Column:
    """A byte count with a binary unit."""
    out = F.concat(F.round(n / 1024.0**4, 2).cast("string"), F.lit(" TiB"))
    for k, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB"), (0, "B")):
        shown = n.cast("long").cast("string") if k == 0 else F.round(n / 1024.0**k, 2).cast("string")
        out = F.when(n < 1024 ** (k + 1), F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def round_half_even(value: float | None, digits: int = 4) -> float | None:
    """Rounding of the exact binary value, for sinks: neither SQL rounding function does that."""
    return None if value is None else round(value, digits)


def file_name(measure: str) -> str:
    """A measure's name as part of a file name."""
    return re.sub(r"[^\w-]", "", measure.replace("/", "-per-"))
