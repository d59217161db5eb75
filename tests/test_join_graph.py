from sparkwhy.plans.equivalence import is_redundant, query_classes
from sparkwhy.plans.join_graph import JoinGraph, enumerate_graphs, graph_json, grow, is_valid, valid_graphs
from sparkwhy.plans.question import Aggregate, Query
from sparkwhy.sources.catalog import TPCH_FOREIGN_KEYS, TPCH_KEYS, Catalog, ForeignKey, Table

STAR = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey", "s_name"], "part": ["p_partkey", "p_name"], "orders": ["o_orderkey", "o_custkey", "o_price"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"],
}


def catalog(tables, keys, foreign):
    made = Catalog({t: None for t in tables}, keys, tuple(foreign))
    made.__dict__["tables"] = {t: Table(t, tuple((c, "nominal") for c in cs), tuple(keys.get(t, ()))) for t, cs in tables.items()}
    return made


def star():
    return catalog(STAR, TPCH_KEYS, [f for f in TPCH_FOREIGN_KEYS if f.child in STAR])


def chain():
    """a <- b <- c."""
    tables = {"a": ["a_id", "a_x"], "b": ["b_id", "a_id", "b_x"], "c": ["c_id", "b_id", "c_x"]}
    return catalog(tables, {"a": ("a_id",), "b": ("b_id",), "c": ("c_id",)}, [ForeignKey("b", ("a_id",), "a", ("a_id",)), ForeignKey("c", ("b_id",), "b", ("b_id",))])


QUERY = Query({"customer": "customer", "orders": "orders"}, ("customer.c_name",), (Aggregate("n", "count"),), (("customer.c_custkey", "orders.o_custkey"),))


def test_counts_on_the_star_schema():
    c = star()
    assert [len(enumerate_graphs(c, ["customer", "orders"], m)) for m in (0, 1, 2, 3, 4)] == [1, 5, 25, 123, 565]
    assert [len([g for g in enumerate_graphs(c, ["customer", "orders"], m) if is_valid(c, g, ["customer", "orders"])]) for m in (1, 2, 3, 4)] == [1, 2, 4, 6]
    assert len(enumerate_graphs(c, ["customer", "orders"], 2, instances="last")) == 21
    assert len(valid_graphs(c, ["orders"], 3)) == 2


def test_chain_by_hand():
    c = chain()
    assert len(enumerate_graphs(c, ["a"], 1)) == 2  # PT, PT-b
    two = enumerate_graphs(c, ["a"], 2)
    assert sorted(g.labels for g in two if len(g.edges) == 2) == [("PT", "b", "a"), ("PT", "b", "b"), ("PT", "b", "c")]
    assert [g.labels for g in valid_graphs(c, ["a"], 2)] == [("PT",), ("PT", "b", "c")]
    assert [g.labels for g in valid_graphs(c, ["a"], 1, strict=False)] == [("PT",), ("PT", "b")]


def test_mapping_table_is_intermediate():
    tables = {"x": ["x_id", "x_v"], "y": ["y_id", "y_v"], "m": ["x_id", "y_id"]}
    c = catalog(tables, {"x": ("x_id",), "y": ("y_id",), "m": ("x_id", "y_id")}, [ForeignKey("m", ("x_id",), "x", ("x_id",)), ForeignKey("m", ("y_id",), "y", ("y_id",))])
    assert c.is_mapping("m") and not c.is_mapping("x")
    graphs = enumerate_graphs(c, ["x"], 2)
    assert [g.intermediate for g in graphs if g.labels == ("PT", "m")] == [True]
    ends = next(g for g in graphs if g.labels == ("PT", "m", "y"))
    assert not ends.intermediate and ends.special == 2


def test_two_keys_to_one_parent_make_parallel_edges():
    tables = {"team": ["t_id", "t_name"], "game": ["home", "away", "points"]}
    c = catalog(tables, {"team": ("t_id",)}, [ForeignKey("game", ("home",), "team", ("t_id",)), ForeignKey("game", ("away",), "team", ("t_id",))])
    first = [g for g in enumerate_graphs(c, ["team"], 1) if g.edges]
    assert len(first) == 2
    parallel = [g for g in grow(c, first[0], ["team"]) if len(g.labels) == 2]
    assert len(parallel) == 1 and len(parallel[0].adjacent(0, 1)) == 2
    assert {g.labels for g in grow(c, first[0], ["team"])} >= {("PT", "game"), ("PT", "game", "game"), ("PT", "game", "team")}


def test_keys_by_labels_and_by_instances():
    c = star()
    by_labels = {g.key("labels") for g in enumerate_graphs(c, ["customer", "orders"], 3)}
    by_instances = {g.key("instances") for g in enumerate_graphs(c, ["customer", "orders"], 3, dedupe="instances")}
    assert len(by_labels) <= len(by_instances)


def test_redundancy():
    c = star()
    assert not is_redundant(c, QUERY, JoinGraph(), equal_keys=True)
    again = next(g for g in enumerate_graphs(c, ["customer", "orders"], 1) if g.labels == ("PT", "customer"))
    assert not is_redundant(c, QUERY, again) and is_redundant(c, QUERY, again, equal_keys=True)
    only_keys = catalog({"k": ["k_id"], "v": ["v_id", "k_id"]}, {"k": ("k_id",)}, [ForeignKey("v", ("k_id",), "k", ("k_id",))])
    q = Query({"v": "v"}, ("v.v_id",), (Aggregate("n", "count"),))
    graph = next(g for g in enumerate_graphs(only_keys, ["v"], 1) if g.edges)
    assert is_redundant(only_keys, q, graph)
    assert [x for x in query_classes(c, QUERY).groups() if len(x) > 1] == [[("q.customer", "c_custkey"), ("q.orders", "o_custkey")]]


def test_json_of_a_graph():
    g = valid_graphs(star(), ["customer", "orders"], 2)[1]
    made = graph_json(g)
    assert [n["name"] for n in made["nodes"]] == ["PT", "nation", "region"] and len(made["links"]) == 2
