"""Patterns: conjunctions of equalities and one-sided bounds for one side of a question."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .apt import Apt


def part_column(part: tuple[str, str, object]) -> Column:
    """One part of a pattern: (attribute, =, < or >, constant)."""
    name, op, value = part
    return F.col(name) == F.lit(value) if op == "=" else F.col(name) > value if op == ">" else F.col(name) < value


@dataclass(frozen=True)
class Pattern:
    nominal: tuple[tuple[str, object], ...] = ()
    ordinal: tuple[tuple[str, str, float], ...] = ()
    is_user: str = "yes"
    rank: int = -2  # of the last numeric attribute in the order of importance
    recall: float = 0.0
    precision: float = 0.0
    f1: float = 0.0
    sample_recall: float | None = None
    sample_precision: float | None = None
    sample_f1: float | None = None
    correlated: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def predicate(self) -> Column:
        """True where every part holds; nulls count as not matching."""
        return F.coalesce(reduce(and_, map(part_column, self.parts()), F.lit(True)), F.lit(False))

    def parts(self) -> list[tuple[str, str, object]]:
        return [(a, "=", v) for a, v in self.nominal] + list(self.ordinal)

    def attributes(self) -> set[str]:
        return {a for a, _ in self.nominal} | {a for a, *_ in self.ordinal}

    def extended(self, attribute: str, op: str, bound: float, rank: int, beside: tuple[str, ...] = ()) -> Pattern:
        return replace(self, ordinal=(*self.ordinal, (attribute, op, bound)), rank=rank, correlated=(*self.correlated, (attribute, beside)))


@dataclass(frozen=True)
class Described:
    """A scored pattern with the names of its tables and columns in place of aliases."""

    pattern: Pattern
    graph_text: str
    graph_name: str
    num_edges: int
    text: str
    tokens: tuple[tuple[str, str], ...]
    correlated: tuple[str, ...]


def shown_value(value: object) -> str:
    if hasattr(value, "strftime"):
        return value.strftime("%Y-%m-%d") if not getattr(value, "hour", 0) and not getattr(value, "minute", 0) and not getattr(value, "second", 0) else str(value)
    return str(value)


def describe(apt: Apt, pattern: Pattern, name: str = "") -> Described:
    """Text parts ``label_node.column=value`` or ``...>bound`` (two digits), sorted and joined by `` ∧ ``."""
    tokens = [(apt.named(a).shown(), "=" + shown_value(v)) for a, v in pattern.nominal]
    tokens += [(apt.named(a).shown(), f"{op}{round(c, 2)}") for a, op, c in pattern.ordinal]
    beside = [apt.named(x).shown() for _, xs in pattern.correlated for x in xs]
    text = " ∧ ".join(sorted(a + v for a, v in tokens))
    return Described(pattern, apt.graph.text(), name, len(apt.graph.edges), text, tuple(tokens), tuple(beside))
