"""Augmented provenance tables: the provenance table joined along a join graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.join_graph import JoinGraph
from ..plans.question import Query, Roles
from ..sources.catalog import NOMINAL, ORDINAL, Catalog
from .provenance import provenance_name, relation_names

FIXED = ("pnumber", "is_user")


@dataclass(frozen=True)
class Attribute:
    """A renamed column of a joined table and where it comes from."""

    name: str
    node: int
    label: str
    column: str
    kind: str
    mined: bool

    def shown(self) -> str:
        """``<label>_<node>.<column>``, numbered from 1."""
        return f"{self.label}_{self.node + 1}.{self.column}"


@dataclass(frozen=True)
class Link:
    """An equality between a node's column and that of a node joined before it."""

    before: int
    theirs: str
    own: str


@dataclass(frozen=True)
class Apt:
    graph: JoinGraph
    rows: DataFrame
    attributes: tuple[Attribute, ...]
    sides: tuple[DataFrame, ...] = ()  # what is joined, by node
    links: tuple[tuple[Link, ...], ...] = ()  # by node, none of the first

    def nominal(self) -> list[str]:
        return [a.name for a in self.attributes if a.mined and a.kind == NOMINAL]

    def ordinal(self) -> list[str]:
        return [a.name for a in self.attributes if a.mined and a.kind == ORDINAL]

    def special(self) -> set[str]:
        """Mined attributes of the node that patterns have to use."""
        return {a.name for a in self.attributes if a.mined and a.node == self.graph.special}

    def named(self, name: str) -> Attribute:
        return next(a for a in self.attributes if a.name == name)


def build(catalog: Catalog, query: Query, pt: DataFrame, roles: Roles, graph: JoinGraph) -> Apt:
    """Join the provenance table with the tables of a join graph, on all edges between joined nodes.

    Columns are renamed ``a_1, a_2, ...`` before any join, so instances of one table and
    self-joins never clash; only ``pnumber`` and ``is_user`` keep their names. Keys, columns
    that the query itself uses, and primary keys of joined tables are not mined.
    """
    attributes: list[Attribute] = []
    names: dict[tuple[int, str], str] = {}
    number = 0
    for c in pt.columns:
        if c in FIXED:
            continue
        number += 1
        names[0, c] = f"a_{number}"
        relation, column = roles.origin.get(c, ("PT", c))
        attributes.append(Attribute(f"a_{number}", 0, "PT" if c not in roles.origin else f"PT_{relation}", column, roles.kinds[c], roles.mineable(c)))
    rows = pt.select(*FIXED, *[F.col(c).alias(names[0, c]) for c in pt.columns if c not in FIXED])
    alias_of = {t: a for a, t in reversed(query.tables.items())}
    shown = relation_names(query)
    sides, links = [rows], [()]
    for node, label in enumerate(graph.labels):
        if node == 0:
            continue
        meta = catalog.tables[label]
        for column, kind in meta.attributes:
            number += 1
            names[node, column] = f"a_{number}"
            attributes.append(Attribute(f"a_{number}", node, label, column, kind, column not in meta.primary_key))
        sides.append(catalog.frame(label).select(*[F.col(c).alias(names[node, c]) for c in meta.columns]))
    joined = {0}
    for node in range(1, len(graph.labels)):
        found = []
        for e in graph.edges:
            if node in (e.a, e.b) and {e.a, e.b} <= joined | {node}:
                for x, y in e.pairs():
                    left, right = names[0, provenance_name(shown[alias_of[e.relation]], x)] if e.a == 0 else names[e.a, x], names[e.b, y]
                    found.append(Link(e.b, right, left) if e.a == node else Link(e.a, left, right))
        links.append(tuple(found))
        rows = rows.join(sides[node], _all(links[node]))
        joined.add(node)
    return Apt(graph, rows, tuple(attributes), tuple(sides), tuple(links))


def _all(links: Sequence[Link]) -> Column | None:
    return reduce(lambda a, b: a & b, [F.col(k.theirs) == F.col(k.own) for k in links]) if links else None


def counts(apt: Apt, by: str, distinct: dict[str, str]) -> DataFrame:
    """``n_rows`` of each group of the joined table, and how many distinct values some attributes have there.

    The rows are not made, as keys that many rows of two tables share have as many rows as their product: each table sends the
    one before it how many rows stand behind each key, and the provenance table multiplies and adds. For distinct values of a
    joined table the groups' keys go the other way. No join here has more rows than one of its tables, times the groups.
    ``by`` is a column of the provenance table; ``distinct`` names outputs and their attributes. Nulls form a group, and are no value.
    """
    before = [{k.before for k in links} for links in apt.links]
    if any(len(b) != 1 for b in before[1:]):
        raise ValueError("every joined table has to be linked with just one before it")
    parent = [None, *[next(iter(b)) for b in before[1:]]]
    own = [list(dict.fromkeys(k.own for k in links)) for links in apt.links]
    reduced = list(apt.sides)  # rows with a partner in all tables behind them, and how many rows these make
    for node in reversed(range(len(reduced))):
        behind = [child for child, p in enumerate(parent) if p == node]
        for child in behind:
            keys = reduced[child].groupBy(*own[child]).agg(F.sum("_n").alias(f"_n{child}"))
            reduced[node] = reduced[node].join(keys, _all(apt.links[child]))
        n = reduce(lambda a, b: a * b, [F.col(f"_n{child}") for child in behind], F.lit(1).cast("long"))
        reduced[node] = reduced[node].select(*apt.sides[node].columns, n.alias("_n"))
    node_of = dict.fromkeys((*FIXED, by), 0) | {a.name: a.node for a in apt.attributes}
    group = F.col(by).alias("_by")
    first = {out: c for out, c in distinct.items() if node_of[c] == 0}
    parts = [reduced[0].groupBy(group).agg(F.sum("_n").alias("n_rows"), *[F.count_distinct(c).alias(out) for out, c in first.items()])]
    for out, c in distinct.items():
        if out in first:
            continue
        path = [node_of[c]]
        while path[0]:
            path.insert(0, parent[path[0]])
        reached = reduced[0].withColumn("_by", group)
        for node in path[1:]:
            keys = reached.select("_by", *dict.fromkeys(k.theirs for k in apt.links[node])).distinct()
            reached = keys.join(reduced[node], _all(apt.links[node]))
        parts.append(reached.groupBy("_by").agg(F.count_distinct(c).alias(out)))
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return together.groupBy(F.col("_by").alias(by)).agg(*[F.max(out).alias(out) for out in ("n_rows", *distinct)])


def estimated_cost(apt: Apt) -> float:
    """Catalyst's estimate of the bytes of the table, without running anything."""
    return float(apt.rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def cheap(apts: list[Apt], costs: dict[int, float] | None = None) -> list[Apt]:
    """Tables whose cost is at most the mean of those with as many edges."""
    costs = costs or {id(a): estimated_cost(a) for a in apts}
    by: dict[int, list[float]] = {}
    for a in apts:
        by.setdefault(len(a.graph.edges), []).append(costs[id(a)])
    return [a for a in apts if costs[id(a)] <= sum(by[len(a.graph.edges)]) / len(by[len(a.graph.edges)])]
