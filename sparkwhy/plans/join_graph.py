"""Join graphs: how tables that a query does not mention can be joined to its provenance.

Everything here is a small structure on the driver. Graphs are immutable.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import permutations

from ..sources.catalog import Catalog, ForeignKey

PT = "PT"


@dataclass(frozen=True)
class Edge:
    """A foreign key between two nodes; at the provenance table, ``relation`` tells whose columns are meant."""

    a: int
    b: int
    key: ForeignKey
    a_is_child: bool
    relation: str | None = None

    def columns(self, node: int) -> tuple[str, ...]:
        """Columns of the edge on one node's side."""
        child = self.a_is_child if node == self.a else not self.a_is_child
        return self.key.child_columns if child else self.key.parent_columns

    def pairs(self) -> list[tuple[str, str]]:
        """(column of a, column of b)."""
        return list(zip(self.columns(self.a), self.columns(self.b), strict=True))


@dataclass(frozen=True)
class JoinGraph:
    """Node k has label ``labels[k]``; node 0 is always the provenance table."""

    labels: tuple[str, ...] = (PT,)
    edges: tuple[Edge, ...] = ()
    intermediate: bool = False
    special: int = 0  # the node whose attributes a pattern has to use

    def text(self, conditions: bool = True) -> str:
        nodes = ", ".join(f"{k + 1}: {x}" for k, x in enumerate(self.labels))
        if not conditions:
            return nodes
        return nodes + " | " + "; ".join(sorted(self._condition(e, True) for e in self.edges))

    def _condition(self, e: Edge, instances: bool) -> str:
        def name(node: int) -> str:
            return f"{self.labels[node]}_{node + 1}" if instances and node else self.labels[node]

        return " AND ".join(f"{name(e.a)}.{x} = {name(e.b)}.{y}" for x, y in e.pairs()) + (f" [{e.relation}]" if instances and e.relation else "")

    def key(self, by: str = "labels") -> tuple:
        """Equal for graphs that count as one: by labels and conditions, or up to the order of instances."""
        if by == "labels":
            return tuple(sorted(self.labels)), tuple(sorted(map(self.sides, self.edges)))
        best = None
        for order in permutations(range(1, len(self.labels))):
            new = {0: 0, **{old: k + 1 for k, old in enumerate(order)}}
            labels = tuple(self.labels[o] for o in order)
            if best is not None and labels > best[0]:
                continue
            edges = tuple(sorted((min(new[e.a], new[e.b]), max(new[e.a], new[e.b]), tuple(sorted(sorted_pair((f"{new[e.a]}.{x}", f"{new[e.b]}.{y}")) for x, y in e.pairs()))) for e in self.edges))
            best = min(best, (labels, edges)) if best else (labels, edges)
        return best

    def sides(self, e: Edge) -> tuple:
        """The equalities of an edge by labels, whichever end they are read from."""
        return tuple(sorted(sorted_pair((f"{self.labels[e.a]}.{x}", f"{self.labels[e.b]}.{y}")) for x, y in e.pairs()))

    def adjacent(self, a: int, b: int) -> list[Edge]:
        return [e for e in self.edges if {e.a, e.b} == {a, b}]


def sorted_pair(pair: tuple[str, str]) -> tuple[str, str]:
    return pair if pair[0] <= pair[1] else (pair[1], pair[0])


def _steps(catalog: Catalog, graph: JoinGraph, relations: Iterable[str]) -> Iterator[tuple[int, str, ForeignKey, bool, str | None]]:
    """(node, label at the far end, key, whether the node is the child, relation if the node is the provenance table)."""
    for node, label in enumerate(graph.labels):
        for table in sorted(set(relations)) if node == 0 else [label]:
            for key in catalog.edges_of(table):
                ends = {(True, key.parent)} if key.child == table else {(False, key.child)}
                if key.child == key.parent:
                    ends = {(True, key.parent), (False, key.child)}
                for is_child, other in sorted(ends):
                    yield node, other, key, is_child, table if node == 0 else None


def grow(catalog: Catalog, graph: JoinGraph, relations: Iterable[str], instances: str = "always") -> Iterator[JoinGraph]:
    """Graphs with one more edge: a further key between adjacent nodes, or a new node.

    ``instances`` tells when a label that the graph has already may get a further node:
    ``always``, or unless the newest node has that label (``last``).
    """
    for node, other, key, is_child, relation in _steps(catalog, graph, relations):
        for far, label in enumerate(graph.labels):
            if far in (0, node) or label != other:
                continue
            between = graph.adjacent(node, far)
            edge = Edge(node, far, key, is_child, relation)
            if between and all(graph.sides(e) != graph.sides(edge) for e in between):
                yield JoinGraph(graph.labels, (*graph.edges, edge), graph.intermediate, graph.special)
        if instances == "last" and graph.labels[-1] == other:
            continue
        new = len(graph.labels)
        mapping = catalog.is_mapping(other)
        edge = Edge(node, new, key, is_child, relation)
        yield JoinGraph((*graph.labels, other), (*graph.edges, edge), mapping, graph.special if mapping else new)


def enumerate_graphs(catalog: Catalog, relations: Iterable[str], max_edges: int, instances: str = "always", dedupe: str = "labels") -> list[JoinGraph]:
    """All join graphs of up to ``max_edges`` edges, breadth first, the provenance table alone first."""
    relations = sorted(set(relations))
    start = JoinGraph()
    seen, out, layer = {start.key(dedupe)}, [start], [start]
    for _ in range(max_edges):
        following = []
        for graph in layer:
            for new in grow(catalog, graph, relations, instances):
                if (k := new.key(dedupe)) not in seen:
                    seen.add(k)
                    following.append(new)
        out += following
        layer = following
    return out


def is_valid(catalog: Catalog, graph: JoinGraph, relations: Iterable[str], strict: bool = True) -> bool:
    """Whether keys are used completely.

    Every foreign key between a node beside the provenance table and a relation of the query
    has to share a column with an edge between the two; and all key columns of a node
    have to occur in its edges (``strict``), or else only those of its first edge.
    """
    for node, label in enumerate(graph.labels):
        if node == 0:
            continue
        at_pt = graph.adjacent(0, node)
        used_at_pt = {c for e in at_pt for c in e.columns(node)}
        if at_pt:
            for relation in set(relations):
                for key in catalog.edges_between(label, relation):
                    if not used_at_pt & set(key.columns_of(label)):
                        return False
        if strict:
            used = {c for e in graph.edges if node in (e.a, e.b) for c in e.columns(node)}
            if not catalog.edge_keys(label) <= used:
                return False
    return True


def valid_graphs(catalog: Catalog, relations: Iterable[str], max_edges: int, strict: bool = True, **options) -> list[JoinGraph]:
    """Valid join graphs that end in a table with attributes of its own."""
    found = enumerate_graphs(catalog, relations, max_edges, **options)
    return [g for g in found if not g.intermediate and is_valid(catalog, g, relations, strict)]


def graph_json(graph: JoinGraph) -> dict:
    """Nodes and links of a join graph, as drawing programs take them."""
    links = [{"source": e.a, "target": e.b, "condition": graph._condition(e, True)} for e in graph.edges]
    return {"nodes": [{"id": k, "name": x} for k, x in enumerate(graph.labels)], "links": links}
