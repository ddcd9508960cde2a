"""Measures: definitions, formulas over other measures, and their compilation to columns."""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_div
from .patterns import PRIMITIVES


class InvalidSourceError(ValueError):
    pass


class CircularDefinitionError(ValueError):
    pass


@dataclass(frozen=True)
class Measure:
    name: str
    description: str
    source: str | None = None  # a formula; None: counted in the trees or the bracket text


# The published measures, in their usual order.
BUILT_IN = (
    Measure("W", "words"), Measure("S", "sentences"), Measure("VP", "verb phrases", "VP1 + VP2"), Measure("C", "clauses", "C1 + C2"), Measure("T", "T-units", "T1 + T2"),
    Measure("DC", "dependent clauses"), Measure("CT", "complex T-units"), Measure("CP", "coordinate phrases"), Measure("CN", "complex nominals", "CN1 + CN2 + CN3"),
    Measure("MLS", "mean length of sentence", "W / S"), Measure("MLT", "mean length of T-unit", "W / T"), Measure("MLC", "mean length of clause", "W / C"),
    Measure("C/S", "clauses per sentence", "C / S"), Measure("VP/T", "verb phrases per T-unit", "VP / T"), Measure("C/T", "clauses per T-unit", "C / T"),
    Measure("DC/C", "dependent clauses per clause", "DC / C"), Measure("DC/T", "dependent clauses per T-unit", "DC / T"), Measure("T/S", "T-units per sentence", "T / S"),
    Measure("CT/T", "complex T-unit ratio", "CT / T"), Measure("CP/T", "coordinate phrases per T-unit", "CP / T"), Measure("CP/C", "coordinate phrases per clause", "CP / C"),
    Measure("CN/T", "complex nominals per T-unit", "CN / T"), Measure("CN/C", "complex nominals per clause", "CN / C"),
)
COUNTED = ("W", *PRIMITIVES)
DEFAULT = tuple(m.name for m in BUILT_IN)


class Registry:
    """Built-in measures and the user's, which come after them or replace them by name."""

    def __init__(self, user: list[dict] | None = None):
        self.measures = {m.name: m for m in BUILT_IN}
        seen = set()
        for d in user or []:
            if any(not k or not v for k, v in d.items()):
                raise ValueError("keys and values of a definition may not be empty")
            name = d["name"]
            if name in seen:
                raise ValueError(f"{name} is defined twice")
            seen.add(name)
            if ("tregex_pattern" in d) == ("value_source" in d):
                raise ValueError(f"{name} needs exactly one of tregex_pattern and value_source")
            if "tregex_pattern" in d:
                raise ValueError(f"{name}: patterns of one's own are not supported")
            self.measures[name] = Measure(name, d.get("description", ""), d["value_source"])
        self.default = tuple(self.measures)

    def formula(self, name: str) -> ast.expr | None:
        if name in self.measures:
            source = self.measures[name].source
            return None if source is None else parse(source)
        if name in COUNTED:
            return None
        raise ValueError(f"no measure {name}")

    def needed(self, names) -> tuple[str, ...]:
        """Counted measures that the named ones depend on, in their fixed order; checks for circles."""
        found: set[str] = set()

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise CircularDefinitionError(" -> ".join([*above, name]))
            tree = self.formula(name)
            if tree is None:
                found.add(name)
                return
            for x in ast.walk(tree):
                if isinstance(x, ast.Name):
                    visit(x.id, (*above, name))

        for name in names:
            visit(name, ())
        return tuple(c for c in COUNTED if c in found)

    def column(self, name: str) -> Column:
        """The measure over columns of counted measures."""
        tree = self.formula(name)
        return F.col(name) if tree is None else self._compile(tree)

    def _compile(self, x: ast.expr) -> Column:
        if isinstance(x, ast.Name):
            return self.column(x.id)
        if isinstance(x, ast.Constant):
            return F.lit(x.value)
        if isinstance(x, ast.UnaryOp):
            value = self._compile(x.operand)
            return -value if isinstance(x.op, ast.USub) else value
        a, b = self._compile(x.left), self._compile(x.right)
        if isinstance(x.op, ast.Div):
            return safe_div(a, b)
        return a + b if isinstance(x.op, ast.Add) else a - b if isinstance(x.op, ast.Sub) else a * b

    def is_sum(self, name: str) -> list[str] | None:
        """Counted measures whose matches the measure's matches are, if it only adds."""
        tree = self.formula(name)
        if tree is None:
            return [name]
        parts: list[str] = []
        for x in ast.walk(tree):
            if isinstance(x, ast.BinOp) and not isinstance(x.op, ast.Add) or isinstance(x, (ast.Constant, ast.UnaryOp)):
                return None
        for x in sorted((x for x in ast.walk(tree) if isinstance(x, ast.Name)), key=lambda x: x.col_offset):
            own = self.is_sum(x.id)
            if own is None:
                return None
            parts += own
        return parts

    def listing(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, m.name, m.description) for i, m in enumerate(self.measures.values())], "ord int, name string, description string")


def parse(source: str) -> ast.expr:
    """The syntax tree of a formula of names, numbers, brackets and + - * /; anything else is refused."""
    try:
        tree = ast.parse(source, mode="eval").body
    except SyntaxError as error:
        raise InvalidSourceError(source) from error
    good = (ast.BinOp, ast.UnaryOp, ast.Name, ast.Constant, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.UAdd, ast.USub, ast.Load)
    for x in ast.walk(tree):
        if not isinstance(x, good) or isinstance(x, ast.Constant) and (isinstance(x.value, bool) or not isinstance(x.value, (int, float))):
            raise InvalidSourceError(source)
    return tree


def select(counted: DataFrame, registry: Registry, names=None, key: str = "doc_id") -> DataFrame:
    """key and the named measures (default: all), repeats named once."""
    names = list(dict.fromkeys(names or registry.default))
    return counted.select(key, *(registry.column(n).alias(n) for n in names))
