"""Descriptions of nodes as columns, and searches of nodes by relations to others.

A description is a function of a table's prefix to a column, so that the same one
serves the node searched for and the nodes around it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import axes
from .trees import basic_category

Description = Callable[[str], Column]


def _label(table: str, basic: bool) -> Column:
    label = F.col(f"{table}.label")
    return basic_category(label) if basic else label


def _sure(c: Column, negated: bool) -> Column:
    """A missing label fits no description, and every negated one."""
    return F.coalesce(~c, F.lit(True)) if negated else F.coalesce(c, F.lit(False))


def text(*labels: str, negated: bool = False, basic: bool = False) -> Description:
    """The label is one of these; basic: its part before the first hyphen is."""
    return lambda t: _sure(_label(t, basic).isin(*labels), negated)


def regex(pattern: str, flags: str = "", negated: bool = False, basic: bool = False) -> Description:
    """The label holds a match of the pattern; flags: i (any case) and x (blanks and comments in the pattern)."""
    if set(flags) - {"i", "x"}:
        raise ValueError(f"unknown flags: {flags}")
    return lambda t: _sure(_label(t, basic).rlike(f"(?{flags}){pattern}" if flags else pattern), negated)


def anything(t: str) -> Column:
    return F.lit(True)


def root(t: str) -> Column:
    return F.col(f"{t}.parent").isNull()


def any_of(*descriptions: Description, negated: bool = False) -> Description:
    """One of the descriptions fits."""

    def fits(t: str) -> Column:
        found = F.lit(False)
        for d in descriptions:
            found = found | d(t)
        return ~found if negated else found

    return fits


@dataclass(frozen=True)
class Related:
    """The node stands in the relation (an axis by name) to a node that fits; or to none, if negated."""

    axis: str
    to: Description = anything
    negated: bool = False
    n: int | None = None
    category: str | None = None

    def pairs(self, nodes: DataFrame) -> DataFrame:
        fitting = nodes.alias("b").where(self.to("b")).select("b.doc_id", "b.tree_id", F.col("b.st").alias("b"))
        return axes.axis(nodes, self.axis, self.n, self.category).join(fitting, ["doc_id", "tree_id", "b"], "left_semi")


def search(nodes: DataFrame, what: Description, *relations: Related) -> DataFrame:
    """doc_id, tree_id and st of the nodes (axis_nodes) that fit and stand in all relations."""
    found = nodes.alias("a").where(what("a")).select("a.doc_id", "a.tree_id", "a.st")
    for r in relations:
        with_partner = r.pairs(nodes).select("doc_id", "tree_id", F.col("a").alias("st"))
        found = found.join(with_partner, ["doc_id", "tree_id", "st"], "left_anti" if r.negated else "left_semi")
    return found
