"""Results as files. Large results stay partitioned; single files are for tables that a person reads."""

from __future__ import annotations

import csv
import json
import sys
import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalar import file_name, round_half_even


def shown(value, digits: int = 4) -> str:
    return str(round_half_even(value, digits) if isinstance(value, float) else value)


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """Partitioned csv (or tsv) with a header."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def rows_as_text(df: DataFrame, digits: int = 4):
    """Rows as they are printed, one partition at a time on the driver."""
    for row in df.toLocalIterator():
        yield {k: shown(v, digits) for k, v in row.asDict().items()}


def write_one(df: DataFrame, path: str | None, kind: str = "csv", digits: int = 4) -> None:
    """One csv, tsv or json file (an array of objects, values as strings), or the terminal without a path."""
    out = open(path, "w", encoding="utf-8", newline="") if path else sys.stdout
    try:
        if kind == "json":
            before = "[\n"
            for row in rows_as_text(df, digits):
                out.write(before + textwrap.indent(json.dumps(row, ensure_ascii=False, indent=2), "  "))
                before = ",\n"
            out.write("[]\n" if before == "[\n" else "\n]\n")
        else:
            writer = csv.DictWriter(out, df.columns, delimiter="\t" if kind == "tsv" else ",")
            writer.writeheader()
            writer.writerows(rows_as_text(df, digits))
    finally:
        if path:
            out.close()


def write_matches(matches: DataFrame, path: str) -> None:
    """A folder a document and measure that has matches, a match a line; measures are named so that they suit files."""
    name = F.regexp_replace(F.replace(F.col("measure"), F.lit("/"), F.lit("-per-")), r"[^\w-]", "")
    rows = matches.select(F.col("doc_id").cast("string").alias("doc"), name.alias("measure_name"), "ord", "match")
    rows.repartition("doc", "measure_name").sortWithinPartitions("doc", "measure_name", "ord").drop("ord").write.mode("overwrite").partitionBy("doc", "measure_name").text(path)


__all__ = ["file_name", "rows_as_text", "shown", "write_matches", "write_one", "write_table"]
