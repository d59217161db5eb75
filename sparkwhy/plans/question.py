"""Select-project-join-aggregate queries and questions about two of their groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import ORDINAL, Catalog

COMPARE = {
    "=": lambda c, v: c == v, "<": lambda c, v: c < v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, ">=": lambda c, v: c >= v,
    "<>": lambda c, v: c != v, "like": lambda c, v: c.like(v), "in": lambda c, v: c.isin(*v),
}


@dataclass(frozen=True)
class Filter:
    """``alias.column op value``; typed values, no SQL text."""

    alias: str
    column: str
    op: str
    value: object

    def on(self, column: Column) -> Column:
        return COMPARE[self.op](column, self.value)


@dataclass(frozen=True)
class Aggregate:
    """An output column: count, count_distinct, sum, avg, min or max of an expression over ``alias.column`` names.

    ``count`` without an expression counts rows. ``share`` is the mean of a 0/1 flag.
    """

    name: str
    kind: str
    expression: str = ""
    digits: int | None = None

    def column(self) -> Column:
        e = F.expr(self.expression) if self.expression else F.lit(1)
        made = {
            "count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
            "share": lambda x: F.sum(x.cast("double")) / F.count(F.lit(1)),
        }[self.kind](e)
        return F.round(made, self.digits) if self.digits is not None else made


@dataclass(frozen=True)
class Query:
    """Tables by alias, equalities between ``alias.column`` names, filters, grouping and aggregates."""

    tables: dict[str, str]
    group_by: tuple[str, ...]
    aggregates: tuple[Aggregate, ...]
    joins: tuple[tuple[str, str], ...] = ()
    filters: tuple[Filter, ...] = ()

    def outputs(self) -> list[str]:
        return [g.split(".")[1] for g in self.group_by] + [a.name for a in self.aggregates]

    def joined(self, catalog: Catalog) -> DataFrame:
        """The select-project-join part; its columns can be named ``alias.column``."""
        out: DataFrame | None = None
        seen: set[str] = set()
        for alias, table in self.tables.items():
            side = catalog.frame(table).alias(alias)
            for f in self.filters:
                if f.alias == alias:
                    side = side.filter(f.on(F.col(f"{alias}.{f.column}")))
            seen.add(alias)
            if out is None:
                out = side
                continue
            on = [F.col(a) == F.col(b) for a, b in self.joins if alias in (a.split(".")[0], b.split(".")[0]) and {a.split(".")[0], b.split(".")[0]} <= seen]
            if not on:
                raise ValueError(f"no join condition connects {alias} with {sorted(seen - {alias})}")
            condition = on[0]
            for c in on[1:]:
                condition = condition & c
            out = out.join(side, condition)
        if out is None:
            raise ValueError("a query needs a table")
        return out

    def result(self, catalog: Catalog) -> DataFrame:
        """The query's own answer."""
        keys = [F.col(g).alias(g.split(".")[1]) for g in self.group_by]
        return self.joined(catalog).groupBy(*keys).agg(*[a.column().alias(a.name) for a in self.aggregates])

    def user_attributes(self) -> set[tuple[str, str]]:
        """(table, column) that the query itself tests or groups by; comparisons of two columns don't count."""
        named = {(self.tables[f.alias], f.column) for f in self.filters}
        return named | {(self.tables[g.split(".")[0]], g.split(".")[1]) for g in self.group_by}


@dataclass(frozen=True)
class Question:
    """Two sides to compare, each as equalities on output columns; no second side means all other rows."""

    query: Query
    first: dict[str, object]
    second: dict[str, object] | None = None
    labels: tuple[str, str] = ("first", "second")

    @staticmethod
    def _all(parts: dict[str, object]) -> Column:
        condition = F.lit(True)
        for name, value in parts.items():
            condition = condition & (F.col(name) == F.lit(value))
        return condition

    def side(self, first: bool) -> Column:
        """Predicate of a side. The complement is NOT (all parts), so rows with a null part are in neither side."""
        if first:
            return self._all(self.first)
        return ~self._all(self.first) if self.second is None else self._all(self.second)


@dataclass
class Roles:
    """What each column of the provenance table is: kind, the table and column it comes from, and how it is used."""

    kinds: dict[str, str] = field(default_factory=dict)
    origin: dict[str, tuple[str, str]] = field(default_factory=dict)
    keys: set[str] = field(default_factory=set)
    user: set[str] = field(default_factory=set)

    def mineable(self, column: str) -> bool:
        return column not in self.keys and column not in self.user

    def ordinal(self, column: str) -> bool:
        return self.kinds[column] == ORDINAL


def run_sql(spark: SparkSession, catalog: Catalog, text: str) -> DataFrame:
    """Any SQL text over the catalog's tables, as views."""
    for name, df in catalog.frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)
