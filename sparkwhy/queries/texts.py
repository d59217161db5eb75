"""SQL texts that several queries share."""

from __future__ import annotations

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
NATION = ["n_nationkey", "n_name", "n_regionkey"]
REGION = ["r_regionkey", "r_name"]


def prov(table: str, columns: list[str]) -> list[str]:
    return [f"prov_{table}_{c.replace('_', '__')}" for c in columns]


PROV = prov("customer", CUSTOMER) + prov("orders", ORDERS)
_SELECTED = ", ".join(f"{c} AS {p}" for c, p in zip(CUSTOMER + ORDERS, PROV, strict=True))
PT_FULL = f"SELECT c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS n_orders, {_SELECTED} FROM customer JOIN orders ON c_custkey = o_custkey"
_NUMBER = "row_number() OVER (ORDER BY prov_customer_c__custkey, prov_orders_o__orderkey) AS pnumber"
PT = (
    f"WITH pt_full AS ({PT_FULL}), pt AS ("
    f"SELECT {_NUMBER}, 'yes' AS is_user, * FROM pt_full WHERE c_mktsegment = 'BUILDING' UNION ALL "
    f"SELECT {_NUMBER}, 'no' AS is_user, * FROM pt_full WHERE c_mktsegment = 'MACHINERY')"
)
_PT_COLUMNS = ["c_mktsegment", "n_orders", *PROV]
_APT_COLUMNS = _PT_COLUMNS + NATION + REGION
_A = ", ".join(f"{c} AS a_{k}" for k, c in enumerate(_APT_COLUMNS, 1))
#: a_4 c_name, a_6 c_acctbal, a_10 o_orderstatus, a_11 o_totalprice, a_12 o_orderdate, a_13 o_orderpriority, a_15 n_name, a_18 r_name
APT = f"{PT}, apt AS (SELECT pnumber, is_user, {_A} FROM pt JOIN nation ON prov_customer_c__nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def r5(x: str) -> str:
    return f"(floor(({x}) * 100000 + 0.5) / 100000)"


#: Scores of made-up patterns: parts by brand (as the join graph) and type (as the pattern).
SCORES = f"scores AS (SELECT p_brand AS jg, p_type AS p_desc, {r5('avg(p_size) / 100.0')} AS fscore, {r5('avg(p_retailprice) / 10000.0')} AS s_score FROM part GROUP BY p_brand, p_type)"
