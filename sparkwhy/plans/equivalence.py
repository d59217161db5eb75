"""Equivalence classes of attributes under the equalities of a query, and redundant join graphs."""

from __future__ import annotations

from collections.abc import Iterable

from ..sources.catalog import Catalog
from .join_graph import JoinGraph
from .question import Query


class Classes:
    """Union-find over (instance, column)."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def equate(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def groups(self) -> list[list]:
        out: dict = {}
        for x in sorted(self.up):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def query_classes(catalog: Catalog, query: Query) -> Classes:
    """Classes of the query's own columns; instances of its tables are named by alias."""
    made = Classes()
    for alias, table in query.tables.items():
        for column in catalog.tables[table].columns:
            made.find((f"q.{alias}", column))
    for a, b in query.joins:
        (x, c), (y, d) = a.split("."), b.split(".")
        made.equate((f"q.{x}", c), (f"q.{y}", d))
    return made


def graph_classes(catalog: Catalog, query: Query, graph: JoinGraph) -> Classes:
    """Classes after the graph's nodes are joined as well."""
    made = query_classes(catalog, query)
    alias_of = {t: a for a, t in reversed(query.tables.items())}
    for node, label in enumerate(graph.labels):
        if node:
            for column in catalog.tables[label].columns:
                made.find((f"n.{node}", column))
    for e in graph.edges:
        for x, y in e.pairs():
            left = (f"q.{alias_of[e.relation]}", x) if e.a == 0 else (f"n.{e.a}", x)
            made.equate(left, (f"n.{e.b}", y))
    return made


def is_redundant(catalog: Catalog, query: Query, graph: JoinGraph, equal_keys: bool = False) -> bool:
    """Whether the graph adds nothing: no new class of attributes.

    With ``equal_keys``, also if two instances of one table, the query's own among them, are
    equated on the table's whole primary key, and so always hold the same row. The
    provenance table alone is never redundant.
    """
    if not graph.edges:
        return False
    before, after = query_classes(catalog, query), graph_classes(catalog, query, graph)
    if len(after.groups()) == len(before.groups()):
        return True
    if not equal_keys:
        return False
    instances: dict[str, list[str]] = {}
    for alias, table in query.tables.items():
        instances.setdefault(table, []).append(f"q.{alias}")
    for node, label in enumerate(graph.labels):
        if node:
            instances.setdefault(label, []).append(f"n.{node}")
    for table, names in instances.items():
        key = catalog.tables[table].primary_key
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if key and all(after.find((a, c)) == after.find((b, c)) for c in key):
                    return True
    return False


def keep_non_redundant(catalog: Catalog, query: Query, graphs: Iterable[JoinGraph], equal_keys: bool = False) -> list[JoinGraph]:
    return [g for g in graphs if not is_redundant(catalog, query, g, equal_keys)]
