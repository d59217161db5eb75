"""Provenance, joined tables, candidate patterns and scores for the question about two market segments."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import coefficient_of_variation, f_score, precision, recall, round5
from ..operators import apt as apts
from ..operators import charts, evaluate, features, lca, provenance, rank, refine, sampling, score
from ..operators.apt import Apt
from ..operators.patterns import Described, Pattern, describe
from ..plans.equivalence import is_redundant
from ..plans.join_graph import enumerate_graphs, is_valid, valid_graphs
from ..plans.question import Aggregate, Query, Question
from ..sources import sinks
from ..sources.catalog import Catalog, ForeignKey
from ..sources.written import new_folder
from . import SEGMENT_QUERY, SEGMENTS, Context, query
from .texts import APT, PROV, PT, PT_FULL, r5

RELATIONS = ("customer", "orders")


def pt_of(x: Context) -> DataFrame:
    return provenance.provenance_table(x.catalog, SEGMENTS)


def apt_of(x: Context) -> Apt:
    """The provenance table joined with nation and region: the smallest valid join graph beyond itself."""
    graph = next(g for g in valid_graphs(x.catalog, RELATIONS, 2) if g.edges)
    return apts.build(x.catalog, SEGMENT_QUERY, pt_of(x), provenance.roles(x.catalog, SEGMENT_QUERY), graph)


# Provenance


@query("pt_full", PT_FULL)
def pt_full(x: Context) -> DataFrame:
    return provenance.provenance_full(x.catalog, SEGMENT_QUERY)


@query(
    "provenance_join",
    f"SELECT p_brand, {r5('avg_price')} AS avg_price, users, p_partkey, l_orderkey, l_linenumber FROM (SELECT p_brand AS g, avg(l_extendedprice) AS avg_price, count(DISTINCT l_suppkey) AS users "
    "FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand) JOIN part ON p_brand IS NOT DISTINCT FROM g JOIN lineitem ON p_partkey = l_partkey",
)
def provenance_join(x: Context) -> DataFrame:
    """A window average and a distinct count, which is aggregated apart and joined null-safely."""
    q = Query({"part": "part", "lineitem": "lineitem"}, ("part.p_brand",), (Aggregate("avg_price", "avg", "l_extendedprice"), Aggregate("users", "count_distinct", "l_suppkey")), (("part.p_partkey", "lineitem.l_partkey"),))
    full = provenance.provenance_full(x.catalog, q)
    names = {"prov_part_p__partkey": "p_partkey", "prov_lineitem_l__orderkey": "l_orderkey", "prov_lineitem_l__linenumber": "l_linenumber"}
    return full.select("p_brand", round5(F.col("avg_price")).alias("avg_price"), "users", *[F.col(k).alias(v) for k, v in names.items()])


@query("pt", f"{PT} SELECT * FROM pt")
def pt(x: Context) -> DataFrame:
    return pt_of(x)


@query(
    "pt_one_group",
    f"SELECT is_user, count(*) AS tuples FROM (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'yes' ELSE 'no' END AS is_user FROM ({PT_FULL})) GROUP BY is_user",
)
def pt_one_group(x: Context) -> DataFrame:
    """A question with one group, which is compared with all others."""
    question = Question(SEGMENT_QUERY, {"c_mktsegment": "BUILDING"})
    return provenance.group_sizes(provenance.provenance_table(x.catalog, question))


@query("pnumber", f"{PT} SELECT is_user, pnumber, prov_orders_o__orderkey AS o_orderkey FROM pt")
def pnumber(x: Context) -> DataFrame:
    return pt_of(x).select("is_user", "pnumber", F.col("prov_orders_o__orderkey").alias("o_orderkey"))


@query("group_sizes", f"{PT} SELECT is_user, count(DISTINCT pnumber) AS tuples FROM pt GROUP BY is_user")
def group_sizes(x: Context) -> DataFrame:
    return provenance.group_sizes(pt_of(x))


_COLUMNS = (
    "c AS (SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' "
    "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'timestamp' END AS data_type, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'ordinal' ELSE 'nominal' END AS kind, "
    "column_name IN ('r_regionkey', 'n_nationkey', 'c_custkey', 's_suppkey', 'p_partkey', 'o_orderkey') AS is_primary, "
    "column_name IN ('r_regionkey', 'n_nationkey', 'n_regionkey', 'c_custkey', 'c_nationkey', 's_suppkey', 's_nationkey', 'p_partkey', 'o_orderkey', 'o_custkey', 'l_orderkey', 'l_partkey', 'l_suppkey') AS in_foreign "
    "FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem'))"
)


@query(
    "column_roles",
    f"WITH {_COLUMNS} SELECT 'prov_' || table_name || '_' || replace(column_name, '_', '__') AS column_name, kind, NOT (is_primary OR in_foreign OR column_name = 'c_mktsegment') AS mined "
    "FROM c WHERE table_name IN ('customer', 'orders') UNION ALL SELECT unnest(['c_mktsegment', 'n_orders', 'is_user', 'pnumber']), 'nominal', false",
)
def column_roles(x: Context) -> DataFrame:
    r = provenance.roles(x.catalog, SEGMENT_QUERY)
    return x.spark.createDataFrame([(c, k, r.mineable(c)) for c, k in sorted(r.kinds.items())], "column_name string, kind string, mined boolean")


# Joined tables


@query("apt_nation_region", f"{APT} SELECT * FROM apt")
def apt_nation_region(x: Context) -> DataFrame:
    return apt_of(x).rows


@query(
    "apt_second_instance",
    f"{PT} SELECT is_user, count(*) AS n_rows, count(DISTINCT pnumber) AS tuples, count(DISTINCT c.c_custkey) AS customers FROM pt JOIN nation ON prov_customer_c__nationkey = n_nationkey "
    "JOIN customer c ON c.c_nationkey = n_nationkey GROUP BY is_user",
)
def apt_second_instance(x: Context) -> DataFrame:
    """A join graph that joins a table of the query once more: customers of the same nation, counted without pairing them with each tuple."""
    graph = next(g for g in enumerate_graphs(x.catalog, RELATIONS, 2) if g.labels == ("PT", "nation", "customer") and g.edges[-1].a == 1)
    apt = apts.build(x.catalog, SEGMENT_QUERY, pt_of(x), provenance.roles(x.catalog, SEGMENT_QUERY), graph)
    key = next(a.name for a in apt.attributes if (a.node, a.column) == (2, "c_custkey"))
    return apts.counts(apt, "is_user", {"tuples": "pnumber", "customers": key})


@query(
    "apt_parallel_edges",
    "SELECT is_user, p_brand, count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS lines FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'yes' ELSE 'no' END AS is_user FROM lineitem WHERE l_returnflag IN ('R', 'A')) "
    "JOIN part ON l_partkey = p_partkey AND l_suppkey = p_partkey GROUP BY is_user, p_brand",
)
def apt_parallel_edges(x: Context) -> DataFrame:
    """Two foreign keys between the same two nodes of a join graph: both conditions hold at once."""
    keys = [ForeignKey("lineitem", (c,), "part", ("p_partkey",)) for c in ("l_partkey", "l_suppkey")]
    catalog = Catalog.from_parquet(x.spark, x.directory, ["lineitem", "part"], {"part": ("p_partkey",)}, keys)
    q = Query({"lineitem": "lineitem"}, ("lineitem.l_returnflag",), (Aggregate("n", "count"),))
    graph = next(g for g in enumerate_graphs(catalog, ["lineitem"], 2) if g.labels == ("PT", "part") and len(g.edges) == 2)
    pt = provenance.provenance_table(catalog, Question(q, {"l_returnflag": "R"}, {"l_returnflag": "A"}))
    apt = apts.build(catalog, q, pt, provenance.roles(catalog, q), graph)
    name = {(a.node, a.column): a.name for a in apt.attributes}
    line = [F.col(name[0, c]) for c in ("l_orderkey", "l_linenumber")]
    return apt.rows.groupBy("is_user", F.col(name[1, "p_brand"]).alias("p_brand")).agg(F.count("*").alias("n_rows"), F.count_distinct(*line).alias("lines"))


@query("count_distinct_side", f"{APT} SELECT is_user, count(DISTINCT pnumber) AS n FROM apt GROUP BY is_user")
def count_distinct_side(x: Context) -> DataFrame:
    return apt_of(x).rows.groupBy("is_user").agg(F.count_distinct("pnumber").alias("n"))


_FRACTION = f"{APT}, w AS (SELECT is_user, a_18, round((1.0 / count(*) OVER (PARTITION BY is_user, pnumber))::DECIMAL(18, 8), 5)::DOUBLE AS prov_value FROM apt)"


@query("fractional_weight", f"{_FRACTION} SELECT is_user, a_18, {r5('sum(prov_value)')} AS weight FROM w GROUP BY is_user, a_18")
def fractional_weight(x: Context) -> DataFrame:
    rows = apt_of(x).rows
    sizes = rows.groupBy("is_user", "pnumber").agg(F.count("*").alias("n"))
    shared = rows.join(sizes, ["is_user", "pnumber"]).withColumn("prov_value", F.round(1 / F.col("n"), 5))
    return shared.groupBy("is_user", "a_18").agg(round5(F.sum("prov_value")).alias("weight"))


# Candidates

_SAMPLES = (
    f"{APT}, d AS (SELECT * FROM apt ORDER BY md5(concat_ws('|', '1', is_user, pnumber)) LIMIT 200), s AS (SELECT * FROM apt ORDER BY md5(concat_ws('|', '2', is_user, pnumber)) LIMIT 200)"
)
_NOMINAL = ["a_10", "a_13", "a_15", "a_18"]
_CELLS = ", ".join(f"CASE WHEN d.{a} = s.{a} THEN d.{a} ELSE NULL END AS {a}" for a in _NOMINAL)
_GROUPS = ", ".join(_NOMINAL)
_LCA = f"{_SAMPLES}, pairs AS (SELECT {_CELLS} FROM d, s), lca AS (SELECT {_GROUPS}, count(*) AS pattern_freq FROM pairs GROUP BY {_GROUPS})"
_TOP = f"ORDER BY pattern_freq DESC, {', '.join(a + ' ASC NULLS LAST' for a in _NOMINAL)} LIMIT"


def _sampled(x: Context) -> tuple[Apt, DataFrame, DataFrame]:
    apt = apt_of(x)
    part = lambda seed: sampling.uniform(apt.rows, 200, seed, ["is_user", "pnumber"])
    return apt, part(1), part(2)


@query("lca_cross_join", f"{_LCA} SELECT count(*) AS pairs, count(a_10) AS same_status, count(a_13) AS same_priority, count(a_15) AS same_nation, count(a_18) AS same_region FROM pairs")
def lca_cross_join(x: Context) -> DataFrame:
    """Pairs of two bounded samples, and on how many each attribute agrees."""
    _, d, s = _sampled(x)
    right = F.broadcast(s.select(*[F.col(a).alias(f"_{a}") for a in _NOMINAL]))
    pairs = d.crossJoin(right)
    same = lambda a, n: F.count(F.when(F.col(a) == F.col(f"_{a}"), 1)).alias(n)
    return pairs.agg(F.count("*").alias("pairs"), same("a_10", "same_status"), same("a_13", "same_priority"), same("a_15", "same_nation"), same("a_18", "same_region"))


@query("lca_frequency", f"{_LCA} SELECT * FROM lca")
def lca_frequency(x: Context) -> DataFrame:
    _, d, s = _sampled(x)
    return lca.common_values(d, s, _NOMINAL, None, 200)


@query("lca_top30", f"{_LCA} SELECT * FROM lca {_TOP} 30")
def lca_top30(x: Context) -> DataFrame:
    _, d, s = _sampled(x)
    return lca.common_values(d, s, _NOMINAL, sample_rows=200)


@query("lca_patterns", f"{_LCA}, top AS (SELECT * FROM lca {_TOP} 30) SELECT * FROM top WHERE coalesce(a_10, a_13, a_15, a_18) IS NOT NULL")
def lca_patterns(x: Context) -> DataFrame:
    _, d, s = _sampled(x)
    return lca.common_values(d, s, _NOMINAL, sample_rows=200).where(F.coalesce(*_NOMINAL).isNotNull())


_REGION_RECALL = (
    f"{APT}, total AS (SELECT sum(n) AS t FROM (SELECT count(DISTINCT pnumber) AS n FROM apt GROUP BY is_user)), r AS ("
    "SELECT a_15, a_18, sum(n)::BIGINT AS found FROM (SELECT is_user, a_15, a_18, count(DISTINCT pnumber) AS n FROM apt GROUP BY is_user, a_15, a_18) GROUP BY a_15, a_18)"
)


def _places(x: Context) -> tuple[DataFrame, list]:
    """The joined rows, and every pair of nation and region as a candidate: at most as many as nations."""
    rows = apt_of(x).rows
    return rows, [(("a_15", r["n_name"]), ("a_18", r["r_name"])) for r in x.t("nation").join(x.t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").distinct().collect()]


@query("nominal_recall", f"{_REGION_RECALL} SELECT a_15, a_18, found, {r5('found::DOUBLE / t')} AS np_recall FROM r, total")
def nominal_recall(x: Context) -> DataFrame:
    """Recall of every pair of nation and region over both sides."""
    made = [(f[0][1], f[1][1], n, r) for f, n, r in lca.recalls(*_places(x)) if n]
    found = x.spark.createDataFrame(made, "a_15 string, a_18 string, found long, np_recall double")
    return found.withColumn("np_recall", round5(F.col("np_recall")))


@query("top10_then_threshold", f"{_REGION_RECALL} SELECT * FROM (SELECT a_15, {r5('found::DOUBLE / t')} AS np_recall FROM r, total ORDER BY found DESC, a_15 LIMIT 10) WHERE np_recall >= 0.04")
def top10_then_threshold(x: Context) -> DataFrame:
    made = [(f[0][1], r) for f, r in lca.by_recall(*_places(x), 0.04)]
    return x.spark.createDataFrame(made, "a_15 string, np_recall double").withColumn("np_recall", round5(F.col("np_recall")))


# Bounds and scores

_QUARTILES = "quantile_cont(a_11, [0.25, 0.5, 0.75])"


@query("refined_quartiles", f"{APT} SELECT a_18, list_extract(q, 1) AS q1, list_extract(q, 2) AS q2, list_extract(q, 3) AS q3 FROM (SELECT a_18, {_QUARTILES} AS q FROM apt GROUP BY a_18)")
def refined_quartiles(x: Context) -> DataFrame:
    apt = apt_of(x)
    regions = sorted(r[0] for r in x.t("region").select("r_name").collect())
    found = refine.quartiles(apt.rows, [(("a_18", r),) for r in regions], ["a_11"])
    rows = [(n[0][1], *b["a_11"]) for n, b in found.items() if len(b["a_11"]) == 3]
    return x.spark.createDataFrame(rows, "a_18 string, q1 double, q2 double, q3 double")


@query("apt_variation", f"{APT} SELECT {r5('stddev_samp(a_11) / avg(a_11)')} AS price, {r5('stddev_samp(a_6) / avg(a_6)')} AS balance FROM apt")
def apt_variation(x: Context) -> DataFrame:
    return apt_of(x).rows.agg(round5(coefficient_of_variation(F.col("a_11"))).alias("price"), round5(coefficient_of_variation(F.col("a_6"))).alias("balance"))


#: Candidates: a region, and orders above or below a price.
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_BOUNDS = [(op, v) for v in (50000.0, 150000.0) for op in (">", "<")]
PATTERNS = [Pattern(nominal=(("a_18", r),), ordinal=(("a_11", op, v),), is_user=s) for r in _REGIONS for op, v in _BOUNDS for s in ("yes", "no")]
_CANDIDATES = (
    f"{APT}, sides AS (SELECT is_user, count(DISTINCT pnumber) AS n FROM apt GROUP BY is_user), c AS (SELECT a_18 AS region, op, v FROM (SELECT r_name AS a_18 FROM region), "
    "(VALUES ('>', 50000.0::DOUBLE), ('<', 50000.0::DOUBLE), ('>', 150000.0::DOUBLE), ('<', 150000.0::DOUBLE)) AS b(op, v)), "
    "m AS (SELECT region, op, v, is_user, count(DISTINCT pnumber) AS n FROM c JOIN apt ON a_18 = region AND CASE WHEN op = '>' THEN a_11 > v ELSE a_11 < v END GROUP BY region, op, v, is_user), "
    "k AS (SELECT region, op, v, s.is_user, coalesce(m.n, 0) AS tp, s.n AS side, coalesce((SELECT sum(o.n) FROM m o WHERE o.region = c.region AND o.op = c.op AND o.v = c.v), 0)::BIGINT AS found "
    "FROM c CROSS JOIN sides s LEFT JOIN m USING (region, op, v, is_user)), "
    f"q AS (SELECT *, {r5('tp::DOUBLE / nullif(side, 0)')} AS recall, tp::DOUBLE / nullif(found, 0) AS prec FROM k)"
)


def _counted(x: Context) -> DataFrame:
    """tp, side and found of all candidates, by the batched scorer."""
    rows = apt_of(x).rows
    sizes = score.side_sizes(rows)
    different = PATTERNS[::2]
    counts = score.matching_tuples(rows, different)
    out = [(p.nominal[0][1], p.ordinal[0][1], p.ordinal[0][2], s, n[s], sizes[s], n["yes"] + n["no"]) for p, n in zip(different, counts, strict=True) for s in ("yes", "no")]
    return x.spark.createDataFrame(out, "region string, op string, v double, is_user string, tp long, side long, found long")


@query("tp_count", f"{_CANDIDATES} SELECT region, op, v, is_user, tp FROM k")
def tp_count(x: Context) -> DataFrame:
    return _counted(x).select("region", "op", "v", "is_user", "tp")


@query("tp_fp_sum", f"{_CANDIDATES} SELECT DISTINCT region, op, v, found FROM k")
def tp_fp_sum(x: Context) -> DataFrame:
    return _counted(x).select("region", "op", "v", "found").distinct()


@query("pattern_recall", f"{_CANDIDATES} SELECT region, op, v, is_user, recall FROM q")
def pattern_recall(x: Context) -> DataFrame:
    return _counted(x).select("region", "op", "v", "is_user", recall(F.col("tp"), F.col("side")).alias("recall"))


@query("pattern_precision", f"{_CANDIDATES} SELECT region, op, v, is_user, {r5('prec')} AS precision FROM q")
def pattern_precision(x: Context) -> DataFrame:
    return _counted(x).select("region", "op", "v", "is_user", round5(precision(F.col("tp"), F.col("found"))).alias("precision"))


_F1 = f"coalesce(2 * {r5('prec * recall / nullif(prec + recall, 0)')}, 0)"


@query("pattern_f1", f"{_CANDIDATES} SELECT region, op, v, is_user, {_F1} AS f1 FROM q")
def pattern_f1(x: Context) -> DataFrame:
    measured = _counted(x).withColumn("r", recall(F.col("tp"), F.col("side"))).withColumn("p", precision(F.col("tp"), F.col("found")))
    return measured.select("region", "op", "v", "is_user", f_score(F.col("p"), F.col("r")).alias("f1"))


@query("recall_gate", f"{_CANDIDATES} SELECT region, op, v, is_user, recall FROM q WHERE recall > 0.1")
def recall_gate(x: Context) -> DataFrame:
    return _counted(x).select("region", "op", "v", "is_user", recall(F.col("tp"), F.col("side")).alias("recall")).where("recall > 0.1")


@query("scored_patterns", f"{_CANDIDATES} SELECT region, op, v, is_user, recall, {_F1} AS f1 FROM q")
def scored_patterns(x: Context) -> DataFrame:
    rows = apt_of(x).rows
    found = score.score(rows, PATTERNS, score.side_sizes(rows))
    return x.spark.createDataFrame([(p.nominal[0][1], *p.ordinal[0][1:], p.is_user, p.recall, p.f1) for p in found], "region string, op string, v double, is_user string, recall double, f1 double")


# Scores on a sample beside those of the whole table


def _on(table: str, end: str) -> str:
    """Scores of the candidates on a table, in q<end>."""
    return (
        f"sides{end} AS (SELECT is_user, count(DISTINCT pnumber) AS n FROM {table} GROUP BY is_user), "
        f"m{end} AS (SELECT region, op, v, is_user, count(DISTINCT pnumber) AS n FROM c JOIN {table} ON a_18 = region AND CASE WHEN op = '>' THEN a_11 > v ELSE a_11 < v END GROUP BY region, op, v, is_user), "
        f"k{end} AS (SELECT c.region, c.op, c.v, u.is_user, coalesce(m{end}.n, 0) AS tp, coalesce(s.n, 0) AS side, coalesce((SELECT sum(o.n) FROM m{end} o WHERE o.region = c.region AND o.op = c.op AND o.v = c.v), 0)::BIGINT AS found "
        f"FROM c CROSS JOIN (VALUES ('yes'), ('no')) AS u(is_user) LEFT JOIN sides{end} s ON s.is_user = u.is_user LEFT JOIN m{end} ON m{end}.region = c.region AND m{end}.op = c.op AND m{end}.v = c.v AND m{end}.is_user = u.is_user), "
        f"p{end} AS (SELECT *, coalesce({r5('tp::DOUBLE / nullif(side, 0)')}, 0) AS recall, tp::DOUBLE / nullif(found, 0) AS prec FROM k{end}), "
        f"q{end} AS (SELECT *, {_F1} AS f1 FROM p{end})"
    )


_BOTH = (
    f"{APT}, c AS (SELECT a_18 AS region, op, v FROM (SELECT r_name AS a_18 FROM region), (VALUES ('>', 50000.0::DOUBLE), ('<', 50000.0::DOUBLE), ('>', 150000.0::DOUBLE), ('<', 150000.0::DOUBLE)) AS b(op, v)), "
    f"d AS (SELECT * FROM apt ORDER BY md5(concat_ws('|', '1', is_user, pnumber)) LIMIT 200), {_on('apt', '_w')}, {_on('d', '_s')}, "
    "e AS (SELECT region, op, v, is_user, w.recall, w.f1, s.recall AS sample_recall, s.f1 AS sample_f1 FROM q_w w JOIN q_s s USING (region, op, v, is_user))"
)


def _both(x: Context, mode: str) -> list[Pattern]:
    apt = apt_of(x)
    sample = sampling.uniform(apt.rows, 200, 1, ["is_user", "pnumber"])
    return score.score(apt.rows, PATTERNS, score.side_sizes(apt.rows), mode, sample)


@query(
    "sampled_scores",
    f"{_BOTH} SELECT 'e' AS mode, * FROM e UNION ALL SELECT 's', region, op, v, is_user, sample_recall, sample_f1, sample_recall, sample_f1 FROM e",
)
def sampled_scores(x: Context) -> DataFrame:
    """Measures in the two modes that use a sample."""
    rows = [(mode, p.nominal[0][1], *p.ordinal[0][1:], p.is_user, p.recall, p.f1, p.sample_recall, p.sample_f1) for mode in "es" for p in _both(x, mode)]
    return x.spark.createDataFrame(rows, "mode string, region string, op string, v double, is_user string, recall double, f1 double, sample_recall double, sample_f1 double")


@query(
    "sampling_error",
    f"{_BOTH} SELECT count(*) AS evaluated, {r5('sum((f1 - sample_f1) * (f1 - sample_f1))')} AS error_sum_of_squares, count(*) FILTER (WHERE (recall > 0.1) <> (sample_recall > 0.1)) AS misclassified FROM e",
)
def sampling_error(x: Context) -> DataFrame:
    found = score.sampling_error(_both(x, "e"), 0.1)
    made = x.spark.createDataFrame([(found["evaluated"], float(found["error_sum_of_squares"]), found["misclassified"])], "evaluated long, error_sum_of_squares double, misclassified long")
    return made.withColumn("error_sum_of_squares", round5(F.col("error_sum_of_squares")))


@query(
    "sample_sizes",
    f"{APT}, n AS (SELECT count(*) AS n FROM apt) SELECT rate, most, greatest(least(ceil(n * rate::DOUBLE)::BIGINT, most), 100)::BIGINT AS candidate_rows, CASE WHEN n > 100 THEN ceil(n * rate::DOUBLE)::BIGINT END AS score_rows "
    "FROM n, (VALUES (0.05), (0.3), (0.9)) AS r(rate), (VALUES (1000), (2600)) AS m(most)".replace("SELECT rate, most", "SELECT rate::DOUBLE AS rate, most::BIGINT AS most"),
)
def sample_sizes(x: Context) -> DataFrame:
    n = apt_of(x).rows.count()
    rows = [(r, m, sampling.lca_size(n, r, 100, m), sampling.score_size(n, r, 100)) for r in (0.05, 0.3, 0.9) for m in (1000, 2600)]
    return x.spark.createDataFrame(rows, "rate double, most long, candidate_rows long, score_rows long")


def _study(size: int) -> str:
    cells = ", ".join(f"CASE WHEN d.{a} = s.{a} THEN d.{a} END AS {a}" for a in _NOMINAL)
    part = lambda seed: f"(SELECT * FROM apt ORDER BY md5(concat_ws('|', '{seed}', is_user, pnumber)) LIMIT {size})"
    return f"SELECT 'sample_{size}' AS exp_desc, {_GROUPS} FROM (SELECT {_GROUPS}, count(*) AS pattern_freq FROM (SELECT {cells} FROM {part(1)} d, {part(2)} s) GROUP BY {_GROUPS} {_TOP} 10)"


@query(
    "lca_study",
    f"{APT}, found AS ({' UNION ALL '.join(f'({_study(n)})' for n in (50, 100, 200))}), best AS (SELECT {_GROUPS} FROM found WHERE exp_desc = 'sample_200'), "
    f"same AS (SELECT exp_desc, count(*) AS n FROM found WHERE EXISTS (SELECT 1 FROM best b WHERE {' AND '.join(f'b.{a} IS NOT DISTINCT FROM found.{a}' for a in _NOMINAL)}) GROUP BY exp_desc) "
    "SELECT exp_desc, count(*) AS num_result_p, any_value(coalesce(same.n, 0)) AS num_match FROM found LEFT JOIN same USING (exp_desc) GROUP BY exp_desc",
)
def lca_study(x: Context) -> DataFrame:
    """How many of the patterns of a sample those of the largest sample have too."""
    found = evaluate.lca_study(apt_of(x).rows, _NOMINAL, [50, 100, 200], by=["is_user", "pnumber"])
    return found.select("exp_desc", "num_result_p", "num_match")


_FRACTIONAL = (
    f"{APT}, w AS (SELECT *, round((1.0 / count(*) OVER (PARTITION BY is_user, pnumber))::DECIMAL(18, 8), 5)::DOUBLE AS pv FROM apt), "
    "f AS (SELECT r_name AS region, s.is_user, (SELECT sum(pv) FROM w WHERE w.a_18 = r_name AND w.is_user = s.is_user) AS tp, (SELECT sum(pv) FROM w WHERE w.is_user = s.is_user) AS side, "
    "(SELECT sum(pv) FROM w WHERE w.a_18 = r_name) AS found FROM region, (VALUES ('yes'), ('no')) AS s(is_user)), "
    f"q AS (SELECT region, is_user, {r5('tp / side')} AS recall, tp / found AS prec FROM f)"
)


@query("fractional_f1", f"{_FRACTIONAL} SELECT region, is_user, recall, {_F1} AS f1 FROM q")
def fractional_f1(x: Context) -> DataFrame:
    patterns = [Pattern(nominal=(("a_18", r),), is_user=s) for r in _REGIONS for s in ("yes", "no")]
    found = score.score_fractional(apt_of(x).rows, patterns)
    return x.spark.createDataFrame([(p.nominal[0][1], p.is_user, r, f) for p, (r, _, f) in zip(patterns, found, strict=True)], "region string, is_user string, recall double, f1 double")


_NAIVE = (
    f"{APT}, sides AS (SELECT is_user, count(DISTINCT pnumber) AS n FROM apt GROUP BY is_user), b AS (SELECT a_18, unnest(quantile_cont(a_11, [0.25, 0.5, 0.75])) AS v FROM apt GROUP BY a_18), "
    "c AS (SELECT a_18 AS region, NULL AS op, NULL::DOUBLE AS v FROM (SELECT DISTINCT a_18 FROM apt) UNION ALL SELECT a_18, op, v FROM (SELECT DISTINCT a_18, v FROM b), (VALUES ('>'), ('<')) AS o(op)), "
    "m AS (SELECT region, op, v, is_user, count(DISTINCT pnumber) AS n FROM c JOIN apt ON a_18 = region AND CASE WHEN op IS NULL THEN true WHEN op = '>' THEN a_11 > v ELSE a_11 < v END GROUP BY region, op, v, is_user), "
    "q AS (SELECT m.region, m.op, m.v, m.is_user, "
    f"{r5('m.n::DOUBLE / s.n')} AS recall, m.n::DOUBLE / (SELECT sum(o.n) FROM m o WHERE o.region = m.region AND o.op IS NOT DISTINCT FROM m.op AND o.v IS NOT DISTINCT FROM m.v) AS prec "
    "FROM m JOIN sides s ON s.is_user = m.is_user)"
)


@query("naive_search", f"{_NAIVE} SELECT region, op, round(v::DECIMAL(18, 4), 2)::DOUBLE AS v, is_user, recall, {_F1} AS f1 FROM q")
def naive_search(x: Context) -> DataFrame:
    """All patterns of a region and at most one bound on the price, at the region's quartiles."""
    apt = apt_of(x)
    rows = apt.rows
    nominal = [(("a_18", r),) for r in _REGIONS]
    sizes = score.side_sizes(rows)
    found = refine.search_all(nominal, refine.quartiles(rows, nominal, ["a_11"]), ["a_11"], apt.special(), lambda tried: score.score(rows, tried, sizes), cap=1)
    out = [(p.nominal[0][1], *(p.ordinal[0][1:] if p.ordinal else (None, None)), p.is_user, p.recall, p.f1) for p in found]
    made = x.spark.createDataFrame(out, "region string, op string, v double, is_user string, recall double, f1 double")
    return made.withColumn("v", F.round(F.col("v").cast("decimal(18,4)"), 2).cast("double"))


@query("chart_counts", f"{APT} SELECT CASE WHEN is_user = 'yes' THEN 'BUILDING' ELSE 'MACHINERY' END AS side, a_10 AS value, count(*) AS cnt FROM apt WHERE a_18 = 'ASIA' GROUP BY is_user, a_10")
def chart_counts(x: Context) -> DataFrame:
    pattern = Pattern(nominal=(("a_10", "F"), ("a_18", "ASIA")))
    return charts.nominal_counts(apt_of(x).rows, pattern, "a_10", SEGMENTS.labels)


@query(
    "chart_histogram",
    f"{APT}, v AS (SELECT CASE WHEN is_user = 'yes' THEN 'BUILDING' ELSE 'MACHINERY' END AS side, a_14 AS value FROM apt WHERE a_18 = 'ASIA'), e AS (SELECT min(value)::DOUBLE AS low, "
    "CASE WHEN max(value) - min(value) > 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS width FROM v) SELECT side, low + floor((value - low) / width) * width AS bin, width, count(*) AS cnt FROM v, e GROUP BY ALL",
)
def chart_histogram(x: Context) -> DataFrame:
    return charts.histogram(apt_of(x).rows, Pattern(nominal=(("a_18", "ASIA"),)), "a_14", SEGMENTS.labels)


# Graphs and searches that SQL doesn't express


@query(
    "schema_graph",
    "SELECT * FROM (VALUES ('nation', 'region', 'region.r_regionkey = nation.n_regionkey'), ('customer', 'nation', 'nation.n_nationkey = customer.c_nationkey'), "
    "('supplier', 'nation', 'nation.n_nationkey = supplier.s_nationkey'), ('orders', 'customer', 'customer.c_custkey = orders.o_custkey'), ('lineitem', 'orders', 'orders.o_orderkey = lineitem.l_orderkey'), "
    "('lineitem', 'part', 'part.p_partkey = lineitem.l_partkey'), ('lineitem', 'supplier', 'supplier.s_suppkey = lineitem.l_suppkey')) AS t(child, parent, condition)",
)
def schema_graph(x: Context) -> DataFrame:
    return x.catalog.edge_rows(x.spark)


@query("catalog_columns", f"WITH {_COLUMNS} SELECT table_name, column_name, data_type, kind, is_primary, in_foreign FROM c")
def catalog_columns(x: Context) -> DataFrame:
    return x.catalog.schema_rows(x.spark)


#: All ways to grow a join graph, by nodes and edges; those alike in labels and conditions are one graph.
_GRAPHS = """
WITH RECURSIVE fk AS (SELECT * FROM (VALUES ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey'),
    ('supplier', 's_nationkey', 'nation', 'n_nationkey'), ('orders', 'o_custkey', 'customer', 'c_custkey'), ('lineitem', 'l_orderkey', 'orders', 'o_orderkey'),
    ('lineitem', 'l_partkey', 'part', 'p_partkey'), ('lineitem', 'l_suppkey', 'supplier', 's_suppkey')) AS t(child, x, parent, y)),
ends AS (SELECT child AS label, x AS c, parent AS other, y AS d FROM fk UNION ALL SELECT parent, y, child, x FROM fk),
step AS (SELECT *, NULL::VARCHAR AS relation FROM ends UNION ALL SELECT 'PT', c, other, d, label FROM ends WHERE label IN ('customer', 'orders')),
grown AS (
    SELECT 0 AS n, ['PT'] AS labels, []::STRUCT(a BIGINT, c VARCHAR, b BIGINT, d VARCHAR, r VARCHAR)[] AS edges
    UNION ALL
    SELECT n + 1, list_append(labels, other), list_append(edges, {'a': node, 'c': c, 'b': len(labels) + 1, 'd': d, 'r': relation})
    FROM (SELECT n, labels, edges, unnest(range(1, len(labels) + 1)) AS node FROM grown WHERE n < 3) JOIN step ON label = labels[node]),
told AS (
    SELECT row_number() OVER () AS id, n, labels, edges, list_aggregate(list_sort(labels), 'string_agg', ',') AS label_key,
        coalesce(list_aggregate(list_sort(list_transform(edges, lambda e: least(labels[e.a] || '.' || e.c, labels[e.b] || '.' || e.d) || '=' || greatest(labels[e.a] || '.' || e.c, labels[e.b] || '.' || e.d))), 'string_agg', ','), '') AS condition_key
    FROM grown),
used AS (
    SELECT id, e.a AS node, e.c AS col, false AS at_pt FROM (SELECT id, unnest(edges) AS e FROM told)
    UNION ALL SELECT id, e.b, e.d, e.a = 1 FROM (SELECT id, unnest(edges) AS e FROM told)),
nodes AS (SELECT id, unnest(labels) AS label, generate_subscripts(labels, 1) AS node FROM told),
open AS (
    SELECT DISTINCT id FROM nodes JOIN (SELECT label AS t, c FROM ends) ON t = label
    WHERE node > 1 AND NOT EXISTS (SELECT 1 FROM used u WHERE u.id = nodes.id AND u.node = nodes.node AND u.col = c)
    UNION SELECT DISTINCT id FROM nodes JOIN (SELECT label AS t, c FROM ends WHERE other IN ('customer', 'orders')) ON t = label
    WHERE EXISTS (SELECT 1 FROM used u WHERE u.id = nodes.id AND u.node = nodes.node AND u.at_pt)
        AND NOT EXISTS (SELECT 1 FROM used u WHERE u.id = nodes.id AND u.node = nodes.node AND u.at_pt AND u.col = c)),
graphs AS (SELECT n::INTEGER AS edges, label_key AS labels, condition_key AS conditions, bool_or(id NOT IN (SELECT id FROM open)) AS valid FROM told GROUP BY ALL)
"""


@query("jg_enumeration", f"{_GRAPHS} SELECT * FROM graphs")
def jg_enumeration(x: Context) -> DataFrame:
    rows = []
    for g in enumerate_graphs(x.catalog, RELATIONS, 3):
        labels, edges = g.key()
        rows.append((len(g.edges), ",".join(labels), ",".join("=".join(pair) for edge in edges for pair in edge), is_valid(x.catalog, g, RELATIONS)))
    return x.spark.createDataFrame(rows, "edges int, labels string, conditions string, valid boolean")


#: Instances of a table whose primary keys a graph equates, by the query's join and the graph's edges.
_REDUNDANT = f"""{_GRAPHS},
pk AS (SELECT * FROM (VALUES ('region', 'r_regionkey'), ('nation', 'n_nationkey'), ('customer', 'c_custkey'), ('supplier', 's_suppkey'), ('part', 'p_partkey'), ('orders', 'o_orderkey')) AS t(t, c)),
instance AS (
    SELECT id, 'n.' || node AS x, label AS t FROM nodes WHERE node > 1
    UNION ALL SELECT id, 'q.' || t, t FROM told, (VALUES ('customer'), ('orders')) AS q(t)),
half AS (
    SELECT id, CASE WHEN e.a = 1 THEN 'q.' || e.r ELSE 'n.' || e.a END AS x, e.c AS c, 'n.' || e.b AS y, e.d AS d FROM (SELECT id, unnest(edges) AS e FROM told)
    UNION ALL SELECT id, 'q.customer', 'c_custkey', 'q.orders', 'o_custkey' FROM told),
equal AS (SELECT * FROM half UNION SELECT id, y, d, x, c FROM half),
reach AS (
    SELECT i.id, i.x AS start, i.t, pk.c AS key, i.x, pk.c FROM instance i JOIN pk ON pk.t = i.t
    UNION SELECT r.id, r.start, r.t, r.key, e.y, e.d FROM reach r JOIN equal e ON e.id = r.id AND e.x = r.x AND e.c = r.c),
twice AS (SELECT DISTINCT r.id FROM reach r JOIN instance i ON i.id = r.id AND i.x = r.x AND i.t = r.t WHERE r.x <> r.start AND r.c = r.key),
fresh AS (SELECT DISTINCT n.id FROM nodes n JOIN information_schema.columns s ON s.table_name = n.label AND s.table_name IN (SELECT label FROM ends) WHERE node > 1 AND NOT EXISTS (SELECT 1 FROM used u WHERE u.id = n.id AND u.node = n.node AND u.col = s.column_name))
"""


@query(
    "jg_redundant",
    f"{_REDUNDANT} SELECT n::INTEGER AS edges, label_key AS labels, condition_key AS conditions, bool_or(n > 0 AND id NOT IN (SELECT id FROM fresh)) AS redundant, "
    "bool_or(n > 0 AND (id NOT IN (SELECT id FROM fresh) OR id IN (SELECT id FROM twice))) AS equal_keys FROM told GROUP BY ALL",
)
def jg_redundant(x: Context) -> DataFrame:
    rows = []
    for g in enumerate_graphs(x.catalog, RELATIONS, 3):
        labels, edges = g.key()
        rows.append((len(g.edges), ",".join(labels), ",".join("=".join(pair) for edge in edges for pair in edge), is_redundant(x.catalog, SEGMENT_QUERY, g), is_redundant(x.catalog, SEGMENT_QUERY, g, equal_keys=True)))
    return x.spark.createDataFrame(rows, "edges int, labels string, conditions string, redundant boolean, equal_keys boolean")


@query("jg_counts", f"{_GRAPHS} SELECT m::INTEGER AS max_edges, count(*)::INTEGER AS graphs, count(*) FILTER (WHERE valid)::INTEGER AS valid FROM graphs, (VALUES (1), (2), (3)) AS t(m) WHERE edges <= m GROUP BY m")
def jg_counts(x: Context) -> DataFrame:
    rows = []
    for m in (1, 2, 3):
        graphs = enumerate_graphs(x.catalog, RELATIONS, m)
        rows.append((m, len(graphs), sum(is_valid(x.catalog, g, RELATIONS) for g in graphs)))
    return x.spark.createDataFrame(rows, "max_edges int, graphs int, valid int")


@query("jg_cost")
def jg_cost(x: Context) -> DataFrame:
    r, p = provenance.roles(x.catalog, SEGMENT_QUERY), pt_of(x)
    made = [apts.build(x.catalog, SEGMENT_QUERY, p, r, g) for g in valid_graphs(x.catalog, RELATIONS, 3)]
    kept = {id(a) for a in apts.cheap(made)}
    return x.spark.createDataFrame([(a.graph.text(), len(a.graph.edges), apts.estimated_cost(a), id(a) in kept) for a in made], "graph string, edges int, cost double, kept boolean")


@query("var_clusters")
def var_clusters(x: Context) -> DataFrame:
    rows = x.t("lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber").orderBy(sampling.hash_order(1, "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")).limit(10_000)
    pandas = rows.toPandas()
    clusters = features.variable_clusters(pandas.to_numpy(), list(pandas.columns))
    return x.spark.createDataFrame([(k, c) for k, cluster in enumerate(clusters) for c in cluster], "cluster int, variable string")


@query("rf_importance")
def rf_importance(x: Context) -> DataFrame:
    apt = apt_of(x)
    chosen = features.choose(apt.rows, apt.ordinal(), apt.special())
    return x.spark.createDataFrame([(apt.named(a).shown(), float(w)) for a, w in chosen.ranked], "attribute string, importance double")


# The level-wise search on one joined table: a region, then bounds on price and balance at the region's quartiles


def _bounds(column: str, name: str) -> str:
    return (
        f"{name} AS (SELECT DISTINCT a_18 AS region, op AS {name}_op, v AS {name}_v FROM (SELECT a_18, unnest(quantile_cont({column}, [0.25, 0.5, 0.75])) AS v FROM apt GROUP BY a_18), "
        "(VALUES ('>'), ('<')) AS o(op) UNION ALL SELECT DISTINCT a_18, NULL, NULL::DOUBLE FROM apt)"
    )


def _holds(column: str, name: str) -> str:
    return f"({name}_op IS NULL OR CASE WHEN {name}_op = '>' THEN {column} > {name}_v ELSE {column} < {name}_v END)"


_LEAST = 0.02
_SEARCHED = (
    f"{APT}, sides AS (SELECT is_user, count(DISTINCT pnumber) AS n FROM apt GROUP BY is_user), {_bounds('a_11', 'price')}, {_bounds('a_6', 'balance')}, "
    f"m AS (SELECT price.region, price_op, price_v, balance_op, balance_v, is_user, count(DISTINCT pnumber) AS n FROM price JOIN balance ON price.region = balance.region "
    f"JOIN apt ON a_18 = price.region AND {_holds('a_11', 'price')} AND {_holds('a_6', 'balance')} GROUP BY ALL), "
    "w AS (SELECT m.*, s.n AS side, sum(m.n) OVER (PARTITION BY region, price_op, price_v, balance_op, balance_v) AS found FROM m JOIN sides s ON s.is_user = m.is_user), "
    f"q AS (SELECT *, {r5('n::DOUBLE / side')} AS recall, n::DOUBLE / found AS prec FROM w), "
    "t AS (SELECT *, CASE WHEN balance_op IS NOT NULL THEN 'balance' || balance_op || floor(balance_v)::BIGINT END AS b, "
    f"CASE WHEN price_op IS NOT NULL THEN 'price' || price_op || floor(price_v)::BIGINT END AS p, {_F1} AS f1 FROM q WHERE recall > {_LEAST}), "
    "pool AS MATERIALIZED (SELECT *, concat_ws(' ∧ ', b, p, 'region=' || region) AS p_desc, row_number() OVER (ORDER BY f1 DESC, is_user, concat_ws(' ∧ ', b, p, 'region=' || region)) AS i FROM t)"
)


def _searched(x: Context, special: set[str] | None = None) -> list[Described]:
    """What the search finds; ``special`` replaces the attributes that patterns have to use."""
    apt = apt_of(x)
    rows, nominal, names = apt.rows, [(("a_18", r),) for r in _REGIONS], {"a_18": "region", "a_11": "price", "a_6": "balance"}
    sizes, total = score.sizes_and_rows(rows)
    chosen = features.Features((("a_11", 1.0), ("a_6", 0.5)), (("a_11", ()), ("a_6", ())), tuple(sorted(special or ())))
    bounds = refine.quartiles(rows, nominal, ["a_11", "a_6"])
    single = total == sum(sizes.values())
    found = refine.search(nominal, bounds, chosen, special or apt.special(), lambda tried: score.score(rows, tried, sizes, single=single), cap=2, least_recall=_LEAST)
    out = []
    for p in found:
        tokens = [(names[a], f"={v}") for a, v in p.nominal] + [(names[a], f"{op}{math.floor(v)}") for a, op, v in p.ordinal]
        out.append(Described(p, "one", p.nominal[0][1], 2, " ∧ ".join(sorted(a + v for a, v in tokens)), tuple(tokens), ()))
    return out


_FOUND = "SELECT region, price_op, round(price_v::DECIMAL(18, 4), 2)::DOUBLE AS price, balance_op, round(balance_v::DECIMAL(18, 4), 2)::DOUBLE AS balance, is_user, recall, f1, p_desc FROM pool"


def _found(x: Context, patterns: list[Described]) -> DataFrame:
    rows = []
    for d in patterns:
        bound = {a: (op, v) for a, op, v in d.pattern.ordinal}
        rows.append((d.graph_name, *bound.get("a_11", (None, None)), *bound.get("a_6", (None, None)), d.pattern.is_user, d.pattern.recall, d.pattern.f1, d.text))
    made = x.spark.createDataFrame(rows, "region string, price_op string, price double, balance_op string, balance double, is_user string, recall double, f1 double, p_desc string")
    return made.withColumns({c: F.round(F.col(c).cast("decimal(18,4)"), 2).cast("double") for c in ("price", "balance")})


@query("levelwise_search", f"{_SEARCHED} {_FOUND}")
def levelwise_search(x: Context) -> DataFrame:
    return _found(x, _searched(x))


@query("forced_special", f"{_SEARCHED} {_FOUND} WHERE price_op IS NOT NULL")
def forced_special(x: Context) -> DataFrame:
    """The price has to be used: regions alone lead nowhere until a bound on it is added."""
    return _found(x, _searched(x, {"a_11"}))


@query(
    "pattern_texts",
    "SELECT r_name AS region, op, v, 'PT_orders_1.o_totalprice' || op || v || ' ∧ region_3.r_name=' || r_name AS p_desc, 'PT, nation, region' AS nodes "
    "FROM region, (VALUES ('>', 50000.0::DOUBLE), ('<', 50000.0::DOUBLE), ('>', 150000.0::DOUBLE), ('<', 150000.0::DOUBLE)) AS b(op, v)",
)
def pattern_texts(x: Context) -> DataFrame:
    """Patterns under the names that their attributes have in the joined tables."""
    apt = apt_of(x)
    rows = [(p.nominal[0][1], *p.ordinal[0][1:], describe(apt, p).text, ", ".join(apt.graph.labels)) for p in PATTERNS[::2]]
    return x.spark.createDataFrame(rows, "region string, op string, v double, p_desc string, nodes string")


@query(
    "attribute_entropy",
    "WITH s AS (SELECT * FROM customer ORDER BY md5(concat_ws('|', '1', c_custkey)) LIMIT 1000), u AS (SELECT 'c_nationkey' AS attribute, c_nationkey::DOUBLE AS v FROM s UNION ALL SELECT 'c_acctbal', c_acctbal FROM s) "
    "SELECT attribute, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT attribute, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY attribute) AS p FROM u GROUP BY attribute, v) GROUP BY attribute",
)
def attribute_entropy(x: Context) -> DataFrame:
    """What decides which attribute stands for a cluster, on a sample of customers."""
    sample = sampling.uniform(x.t("customer"), 1000, 1, ["c_custkey"]).toPandas()
    rows = [(c, round(features.value_entropy(sample[c].to_numpy(float)), 6)) for c in ("c_nationkey", "c_acctbal")]
    return x.spark.createDataFrame(rows, "attribute string, entropy double")


def _unlike(c: str, o: str) -> str:
    """How a candidate differs from a chosen pattern: its score and the mean over its parts."""
    part = lambda x: f"CASE WHEN {c}.{x} IS NULL THEN 0.0 WHEN {o}.{x} IS NULL THEN 1.0 WHEN {c}.{x} = {o}.{x} THEN -2.0 ELSE -0.3 END::DOUBLE"
    return f"({c}.f1 + ({part('region')} + {part('p')} + {part('b')}) / (1 + ({c}.p IS NOT NULL)::INT + ({c}.b IS NOT NULL)::INT))"


def _diversified(k: int) -> str:
    steps = [f"low1 AS MATERIALIZED (SELECT c.i, {_unlike('c', 'o')} AS low FROM pool c JOIN pool o ON o.i = 1 WHERE c.i <> 1)", "pick1 AS (SELECT 1::BIGINT AS place, 1::BIGINT AS i)"]
    for at in range(2, k + 1):
        steps.append(f"pick{at} AS MATERIALIZED (SELECT {at}::BIGINT AS place, i FROM low{at - 1} ORDER BY low DESC, i LIMIT 1)")
        steps.append(f"low{at} AS MATERIALIZED (SELECT c.i, least(l.low, {_unlike('c', 'o')}) AS low FROM low{at - 1} l JOIN pool c ON c.i = l.i JOIN pool o ON o.i IN (SELECT i FROM pick{at}) WHERE c.i <> o.i)")
    picks = " UNION ALL ".join(f"SELECT * FROM pick{at}" for at in range(1, k + 1))
    return f"{_SEARCHED}, {', '.join(steps)} SELECT place, is_user, p_desc, f1 FROM ({picks}) JOIN pool USING (i)"


@query("diversified", _diversified(10))
def diversified(x: Context) -> DataFrame:
    pool = [replace(d, graph_name="one") for d in _searched(x)]
    rows = [(k, d.pattern.is_user, d.text, d.pattern.f1) for k, d in enumerate(rank.diversified(pool, 10), 1)]
    return x.spark.createDataFrame(rows, "place long, is_user string, p_desc string, f1 double")


@query(
    "best_of_best",
    f"{_SEARCHED}, e AS (SELECT region, round(-sum(share * ln(share)), 9) AS entropy FROM (SELECT region, count(*) / sum(count(*)) OVER (PARTITION BY region) AS share FROM pool GROUP BY region, f1) GROUP BY region), "
    "top AS (SELECT region, row_number() OVER (ORDER BY entropy DESC, region) AS graph_place FROM e) "
    "SELECT * FROM (SELECT graph_place, row_number() OVER (PARTITION BY region ORDER BY i) AS place, region, is_user, p_desc, f1 FROM pool JOIN top USING (region)) WHERE graph_place <= 3 AND place <= 5",
)
def best_of_best(x: Context) -> DataFrame:
    """The best patterns of the best groups, where the regions stand for join graphs."""
    found = rank.best_of_best(_searched(x), 3, 5)
    graphs = list(dict.fromkeys(d.graph_name for d in found))
    rows, seen = [], Counter()
    for d in found:
        seen[d.graph_name] += 1
        rows.append((graphs.index(d.graph_name) + 1, seen[d.graph_name], d.graph_name, d.pattern.is_user, d.text, d.pattern.f1))
    return x.spark.createDataFrame(rows, "graph_place long, place long, region string, is_user string, p_desc string, f1 double")


@query("saved_tables", f"{_SEARCHED} SELECT 'patterns' AS name, is_user, p_desc, recall, f1 AS fscore FROM pool UNION ALL SELECT 'best', is_user, p_desc, recall, f1 FROM pool WHERE i <= 20")
def saved_tables(x: Context) -> DataFrame:
    """Result tables written in two appends and read back."""
    found, out = rank.globally([replace(d, graph_name="one") for d in _searched(x)]), None
    directory = new_folder(x.spark, "saved")
    for name, part in (("patterns", found), ("best", found[:20])):
        for some in (part[::2], part[1::2]):
            sinks.append(sinks.pattern_rows(x.spark, some, "run", ("yes", "no")), directory, name)
        rows = x.spark.read.schema(sinks.PATTERN_SCHEMA).parquet(f"{directory}/{name}").select(F.lit(name).alias("name"), "is_user", "p_desc", "recall", "fscore")
        out = rows if out is None else out.unionByName(rows)
    return out
