"""Named questions about the star schema, one for each shape of query that users bring."""

from __future__ import annotations

from .plans.question import Aggregate, Filter, Query, Question

_ORDERS = {"c": "customer", "o": "orders"}
_ORDERS_ON = (("c.c_custkey", "o.o_custkey"),)
_LINES = {"o": "orders", "l": "lineitem", "p": "part"}
_LINES_ON = (("o.o_orderkey", "l.l_orderkey"), ("l.l_partkey", "p.p_partkey"))

WORKLOADS: dict[str, Question] = {
    # count by group over a join, two groups
    "segments": Question(Query(_ORDERS, ("c.c_mktsegment",), (Aggregate("n", "count"),), _ORDERS_ON), {"c_mktsegment": "BUILDING"}, {"c_mktsegment": "MACHINERY"}, ("BUILDING", "MACHINERY")),
    # average by group over a longer join with a filter
    "prices": Question(
        Query(_LINES, ("o.o_orderpriority",), (Aggregate("avg_price", "avg", "l.l_extendedprice", 2),), _LINES_ON, (Filter("p", "p_size", "<", 20),)),
        {"o_orderpriority": "1-URGENT"}, {"o_orderpriority": "5-LOW"}, ("urgent", "low"),
    ),
    # share of a flag by group
    "returns": Question(
        Query({"l": "lineitem", "p": "part"}, ("p.p_brand",), (Aggregate("returned", "share", "l.l_returnflag = 'R'"),), (("l.l_partkey", "p.p_partkey"),)),
        {"p_brand": "Brand#11"}, {"p_brand": "Brand#22"}, ("Brand#11", "Brand#22"),
    ),
    # one table, one group against all others
    "status": Question(Query({"o": "orders"}, ("o.o_orderstatus",), (Aggregate("n", "count"),)), {"o_orderstatus": "P"}, None, ("pending", "others")),
    # sum by an attribute of a joined table
    "nations": Question(
        Query({"n": "nation", **_ORDERS}, ("n.n_name",), (Aggregate("total", "sum", "o.o_totalprice"),), (("n.n_nationkey", "c.c_nationkey"), *_ORDERS_ON)),
        {"n_name": "NATION_1"}, None, ("NATION_1", "others"),
    ),
}
