"""Scans, filters, joins, aggregates, windows, samples, set operations and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import bin_width, coefficient_of_variation, round5
from ..functions.text import highlighted, pattern_text, pattern_triplets, trigram_similarity
from ..operators import sampling
from ..plans.question import Aggregate, Query, run_sql
from . import Context, query
from .texts import r5

# Scans, projections, filters


@query("scan_base", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_base(x: Context) -> DataFrame:
    return x.catalog.frame("customer")


@query("rename_projection", "SELECT n_nationkey AS a_1, n_name AS a_2, n_regionkey AS a_3 FROM nation")
def rename_projection(x: Context) -> DataFrame:
    return x.t("nation").select(*[F.col(c).alias(f"a_{k}") for k, c in enumerate(x.t("nation").columns, 1)])


@query("const_column", "SELECT o_orderkey, 'yes' AS is_user FROM orders WHERE o_orderstatus = 'F'")
def const_column(x: Context) -> DataFrame:
    return x.t("orders").where("o_orderstatus = 'F'").select("o_orderkey", F.lit("yes").alias("is_user"))


@query("filter_group", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_group(x: Context) -> DataFrame:
    return x.t("orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_totalprice")


@query("filter_complement", "SELECT o_orderkey FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def filter_complement(x: Context) -> DataFrame:
    return x.t("orders").where(~((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))).select("o_orderkey")


@query("filter_pattern", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 AND o_totalprice < 250000")
def filter_pattern(x: Context) -> DataFrame:
    price = F.col("o_totalprice")
    return x.t("orders").where((F.col("o_orderstatus") == "O") & (price > 1000) & (price < 250000)).select("o_orderkey", "o_totalprice")


@query("like_filter", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_brand NOT LIKE '%1%'")
def like_filter(x: Context) -> DataFrame:
    return x.t("part").where(F.col("p_type").like("%A%") & ~F.col("p_brand").like("%1%")).select("p_partkey", "p_type")


@query(
    "null_filter",
    "SELECT c_custkey, o_orderkey IS NULL AS without_orders FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders "
    "GROUP BY o_custkey) ON c_custkey = o_custkey WHERE c_name IS NOT NULL",
)
def null_filter(x: Context) -> DataFrame:
    first = x.t("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    joined = x.t("customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where(F.col("c_name").isNotNull()).select("c_custkey", F.col("o_orderkey").isNull().alias("without_orders"))


@query("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def in_subquery(x: Context) -> DataFrame:
    rich = x.t("orders").where("o_totalprice > 300000")
    return x.t("customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def not_in_subquery(x: Context) -> DataFrame:
    pending = x.t("orders").where("o_orderstatus = 'P'")
    return x.t("customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def scalar_subquery(x: Context) -> DataFrame:
    return run_sql(x.spark, x.catalog, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")


@query(
    "drop_constants",
    "SELECT * FROM (SELECT 'o_orderkey' AS column_name, min(o_orderkey) <> max(o_orderkey) AS varies FROM orders "
    "UNION ALL SELECT 'o_totalprice', min(o_totalprice) <> max(o_totalprice) FROM orders UNION ALL SELECT 'one', false)",
)
def drop_constants(x: Context) -> DataFrame:
    rows = x.t("orders").withColumn("one", F.lit(1))
    names = ["o_orderkey", "o_totalprice", "one"]
    wide = rows.agg(*[(F.min(c) != F.max(c)).alias(c) for c in names])
    return wide.unpivot([], names, "column_name", "varies")


@query("user_attributes", "SELECT * FROM (VALUES ('customer', 'c_mktsegment', 'group'), ('orders', 'o_orderstatus', 'filter')) AS t(table_name, column_name, used_as)")
def user_attributes(x: Context) -> DataFrame:
    from ..plans.question import Filter

    q = Query({"c": "customer", "o": "orders"}, ("c.c_mktsegment",), (Aggregate("n", "count"),), (("c.c_custkey", "o.o_custkey"),), (Filter("o", "o_orderstatus", "=", "F"),))
    grouped = {(q.tables[g.split(".")[0]], g.split(".")[1]) for g in q.group_by}
    return x.spark.createDataFrame([(t, c, "group" if (t, c) in grouped else "filter") for t, c in sorted(q.user_attributes())], "table_name string, column_name string, used_as string")


@query("csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(x: Context) -> DataFrame:
    import uuid

    from ..sources.written import shared_folder

    path = f"{shared_folder(x.spark)}/csv-{uuid.uuid4().hex}"
    nation = x.t("nation")
    nation.write.option("header", True).csv(path)
    return x.spark.read.option("header", True).schema(nation.schema).csv(path)


# Joins


@query("spj_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def spj_join(x: Context) -> DataFrame:
    q = Query({"o": "orders", "c": "customer", "n": "nation"}, (), (), (("o.o_custkey", "c.c_custkey"), ("c.c_nationkey", "n.n_nationkey")))
    return q.joined(x.catalog).select("o_orderkey", "c_name", "n_name")


@query("parallel_edge_join", "SELECT o_orderkey, l_linenumber, l_suppkey, p_size FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey AND p_size > l_linenumber")
def parallel_edge_join(x: Context) -> DataFrame:
    lines = x.t("lineitem").join(x.t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = (F.col("p_partkey") == F.col("l_partkey")) & (F.col("p_size") > F.col("l_linenumber"))
    return lines.join(x.t("part"), both).select("o_orderkey", "l_linenumber", "l_suppkey", "p_size")


@query("self_rejoin", "SELECT a.c_custkey, count(*) AS neighbours FROM customer a JOIN (SELECT c_nationkey, c_mktsegment FROM customer) b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment GROUP BY a.c_custkey")
def self_rejoin(x: Context) -> DataFrame:
    """Customers beside those of the same nation and segment: counted per pair of keys before the join."""
    counts = x.t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("neighbours"))
    return x.t("customer").join(counts, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "neighbours")


@query("weight_join", "SELECT c_custkey, cnt FROM customer JOIN (SELECT c_nationkey AS n, count(*) AS cnt FROM customer GROUP BY c_nationkey) ON c_nationkey = n")
def weight_join(x: Context) -> DataFrame:
    weights = x.t("customer").groupBy("c_nationkey").agg(F.count("*").alias("cnt"))
    return x.t("customer").join(weights, "c_nationkey").select("c_custkey", "cnt")


@query("stats_join", "SELECT o_custkey, n, c_name FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) JOIN customer ON c_custkey = o_custkey")
def stats_join(x: Context) -> DataFrame:
    n = x.t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.join(x.t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_custkey", "n", "c_name")


@query("correlated_scalar", "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region_name FROM nation")
def correlated_scalar(x: Context) -> DataFrame:
    return run_sql(x.spark, x.catalog, "SELECT n_nationkey, (SELECT first(r_name) FROM region WHERE r_regionkey = n_regionkey) AS region_name FROM nation")


@query("semi_join", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')")
def semi_join(x: Context) -> DataFrame:
    returned = x.t("lineitem").where("l_returnflag = 'R'")
    return x.t("supplier").join(returned, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


@query("anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_join(x: Context) -> DataFrame:
    large = x.t("lineitem").where("l_quantity > 45")
    return x.t("part").join(large, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query(
    "full_outer",
    "SELECT coalesce(a.k, b.k) AS k, a.n AS n_first, b.n AS n_second FROM (SELECT p_size AS k, count(*) AS n FROM part WHERE p_brand < 'Brand#3' GROUP BY p_size) a "
    "FULL OUTER JOIN (SELECT p_size AS k, count(*) AS n FROM part WHERE p_retailprice > 1500 GROUP BY p_size) b ON a.k = b.k",
)
def full_outer(x: Context) -> DataFrame:
    a = x.t("part").where("p_brand < 'Brand#3'").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("n_first"))
    b = x.t("part").where("p_retailprice > 1500").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("n_second"))
    return a.join(b, "k", "full_outer")


# Aggregates


@query("group_avg", f"SELECT o_orderpriority, {r5('avg(l_extendedprice)')} AS avg_price FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def group_avg(x: Context) -> DataFrame:
    joined = x.t("orders").join(x.t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(round5(F.avg("l_extendedprice")).alias("avg_price"))


@query("group_ratio", f"SELECT p_brand, {r5('1.0::DOUBLE * sum(CASE WHEN l_returnflag = chr(82) THEN 1 ELSE 0 END) / count(*)')} AS returned FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand")
def group_ratio(x: Context) -> DataFrame:
    q = Query({"p": "part", "l": "lineitem"}, ("p.p_brand",), (Aggregate("returned", "share", "l.l_returnflag = 'R'"),), (("p.p_partkey", "l.l_partkey"),))
    return q.result(x.catalog).select("p_brand", round5(F.col("returned")).alias("returned"))


@query("group_sum_count", f"SELECT n_name, count(*) AS n, {r5('sum(o_totalprice) / 1000000')} AS millions FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def group_sum_count(x: Context) -> DataFrame:
    joined = x.t("orders").join(x.t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(x.t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), round5(F.sum("o_totalprice") / 1000000).alias("millions"))


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(x: Context) -> DataFrame:
    return x.t("lineitem").agg(F.count("*").alias("n"))


@query("events_by_type", f"SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, {r5('avg(value)')} AS mean FROM events GROUP BY event_type")
def events_by_type(x: Context) -> DataFrame:
    return x.t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), round5(F.avg("value")).alias("mean"))


@query("distinct_per_column", "SELECT count(DISTINCT l_returnflag) AS cnt_flag, count(DISTINCT l_linestatus) AS cnt_status, count(DISTINCT l_partkey) AS cnt_part FROM lineitem")
def distinct_per_column(x: Context) -> DataFrame:
    names = {"l_returnflag": "cnt_flag", "l_linestatus": "cnt_status", "l_partkey": "cnt_part"}
    return x.t("lineitem").agg(*[F.count_distinct(c).alias(n) for c, n in names.items()])


@query("quartiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_returnflag")
def quartiles(x: Context) -> DataFrame:
    q = F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    return x.t("lineitem").groupBy("l_returnflag").agg(q).select("l_returnflag", *[F.col("q")[k].alias(f"q{k + 1}") for k in range(3)])


@query("quartile_union", "SELECT DISTINCT p_brand, q FROM (SELECT p_brand, unnest([quantile_cont(p_size, 0.25), quantile_cont(p_size, 0.5), quantile_cont(p_size, 0.75)]) AS q FROM part GROUP BY p_brand)")
def quartile_union(x: Context) -> DataFrame:
    q = F.percentile("p_size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return x.t("part").groupBy("p_brand").agg(q.alias("q")).select("p_brand", F.explode(F.array_distinct("q")).alias("q"))


@query("coef_variation", f"SELECT p_brand, {r5('stddev_samp(p_retailprice) / avg(p_retailprice)')} AS cv FROM part GROUP BY p_brand")
def coef_variation(x: Context) -> DataFrame:
    return x.t("part").groupBy("p_brand").agg(round5(coefficient_of_variation(F.col("p_retailprice"))).alias("cv"))


@query("group_weight", "SELECT l_returnflag, count(*) AS cnt FROM lineitem GROUP BY l_returnflag")
def group_weight(x: Context) -> DataFrame:
    return x.t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("cnt"))


@query("string_agg", "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def string_agg(x: Context) -> DataFrame:
    return x.t("nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("names"))


@query("array_agg", "SELECT n_regionkey, array_to_string(array_agg(n_nationkey ORDER BY n_nationkey), ',') AS nations FROM nation GROUP BY n_regionkey")
def array_agg(x: Context) -> DataFrame:
    return x.t("nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("n_nationkey")), lambda k: k.cast("string")), ",").alias("nations"))


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(x: Context) -> DataFrame:
    return x.t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("min_max", "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders")
def min_max(x: Context) -> DataFrame:
    return x.t("orders").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))


@query("bin_size", "SELECT l_returnflag, CASE WHEN abs(max(l_discount) - min(l_discount)) > 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS discount_bin, CASE WHEN abs(max(l_quantity) - min(l_quantity)) > 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS quantity_bin FROM lineitem GROUP BY l_returnflag")
def bin_size(x: Context) -> DataFrame:
    width = lambda c: bin_width(F.min(c), F.max(c))
    return x.t("lineitem").groupBy("l_returnflag").agg(width("l_discount").alias("discount_bin"), width("l_quantity").alias("quantity_bin"))


@query("entropy", f"SELECT {r5('-sum(n / t * ln(n / t))')} AS entropy FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t FROM orders GROUP BY o_orderpriority)")
def entropy(x: Context) -> DataFrame:
    counts = x.t("orders").groupBy("o_orderpriority").agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    return counts.agg(round5(F.log(total) - F.sum(F.col("n") * F.log("n")) / total).alias("entropy"))


@query("distinct_graphs", "SELECT count(DISTINCT p_brand) AS graphs, count(*) AS patterns FROM part")
def distinct_graphs(x: Context) -> DataFrame:
    return x.t("part").agg(F.count_distinct("p_brand").alias("graphs"), F.count("*").alias("patterns"))


@query("group_by_join", "SELECT r_name, c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment, o_orderstatus")
def group_by_join(x: Context) -> DataFrame:
    joins = (("o.o_custkey", "c.c_custkey"), ("c.c_nationkey", "n.n_nationkey"), ("n.n_regionkey", "r.r_regionkey"))
    q = Query({"o": "orders", "c": "customer", "n": "nation", "r": "region"}, ("r.r_name", "c.c_mktsegment", "o.o_orderstatus"), (Aggregate("n", "count"),), joins)
    return q.result(x.catalog)


# Windows and samples


@query("row_ids", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS id FROM part")
def row_ids(x: Context) -> DataFrame:
    window = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return x.t("part").select("p_partkey", F.row_number().over(window).cast("long").alias("id"))


@query("uniform_sample", "SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('|', '7', o_orderkey)) LIMIT 100")
def uniform_sample(x: Context) -> DataFrame:
    return sampling.uniform(x.t("orders"), 100, 7, ["o_orderkey"]).select("o_orderkey")


_UNIT = "('0x' || substr(md5(concat_ws('|', '7', o_orderkey)), 1, 8))::BIGINT / 4294967296.0"


@query("weighted_sample_nominal", f"SELECT o_orderkey FROM orders JOIN (SELECT o_orderpriority AS v, count(*) AS cnt FROM orders GROUP BY v) ON o_orderpriority = v ORDER BY ({_UNIT}) * cnt DESC, o_orderkey LIMIT 100")
def weighted_sample_nominal(x: Context) -> DataFrame:
    return sampling.weighted_by_count(x.t("orders"), "o_orderpriority", 100, 7, ["o_orderkey"]).select("o_orderkey")


@query(
    "weighted_sample_cv",
    f"SELECT o_orderkey FROM orders JOIN (SELECT o_orderpriority AS v, count(*) * (stddev_samp(o_totalprice) / avg(o_totalprice)) AS w FROM orders GROUP BY v) ON o_orderpriority = v ORDER BY ({_UNIT}) * w DESC, o_orderkey LIMIT 100",
)
def weighted_sample_cv(x: Context) -> DataFrame:
    return sampling.weighted_by_spread(x.t("orders"), "o_orderpriority", "o_totalprice", 100, 7, ["o_orderkey"]).select("o_orderkey")


@query("top_by_text", "SELECT p_partkey, p_name, length(p_name) AS n FROM part ORDER BY length(p_name) DESC, p_name, p_partkey LIMIT 20")
def top_by_text(x: Context) -> DataFrame:
    n = F.length("p_name")
    return x.t("part").select("p_partkey", "p_name", n.alias("n")).orderBy(F.desc("n"), "p_name", "p_partkey").limit(20)


# Set operations


@query("union_all_sides", "SELECT o_orderkey, 'yes' AS is_user FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'no' FROM orders WHERE o_orderstatus <> 'F'")
def union_all_sides(x: Context) -> DataFrame:
    side = lambda c, v: x.t("orders").where(c).select("o_orderkey", F.lit(v).alias("is_user"))
    return side("o_orderstatus = 'F'", "yes").unionByName(side("o_orderstatus <> 'F'", "no"))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(x: Context) -> DataFrame:
    return x.t("customer").select(F.col("c_nationkey").alias("k")).union(x.t("supplier").select("s_nationkey")).distinct()


# Scalar expressions


@query("case_lca", "SELECT a.n_nationkey, CASE WHEN a.n_regionkey = b.r_regionkey THEN a.n_regionkey ELSE NULL END AS same FROM nation a JOIN region b ON a.n_nationkey % 5 = b.r_regionkey")
def case_lca(x: Context) -> DataFrame:
    joined = x.t("nation").join(x.t("region"), F.col("n_nationkey") % 5 == F.col("r_regionkey"))
    return joined.select("n_nationkey", F.when(F.col("n_regionkey") == F.col("r_regionkey"), F.col("n_regionkey")).alias("same"))


@query("case_label", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END AS label FROM orders")
def case_label(x: Context) -> DataFrame:
    return x.t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "finished").otherwise("open").alias("label"))


@query("coalesce_case", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def coalesce_case(x: Context) -> DataFrame:
    n = x.t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return x.t("customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("round_digits", f"SELECT l_orderkey, l_linenumber, {r5('l_extendedprice / 7')} AS r FROM lineitem")
def round_digits(x: Context) -> DataFrame:
    return x.t("lineitem").select("l_orderkey", "l_linenumber", round5(F.col("l_extendedprice") / 7).alias("r"))


@query("nullif_div", f"SELECT p_partkey, {r5('p_retailprice / nullif(p_size - 10, 0)')} AS r FROM part")
def nullif_div(x: Context) -> DataFrame:
    return x.t("part").select("p_partkey", round5(F.col("p_retailprice") / F.nullif(F.col("p_size") - 10, F.lit(0))).alias("r"))


@query("casts", "SELECT p_partkey, p_size::DOUBLE AS as_double, p_size::VARCHAR AS as_text, floor(p_retailprice)::BIGINT AS as_long, -p_size AS negative FROM part")
def casts(x: Context) -> DataFrame:
    return x.t("part").select(
        "p_partkey", F.col("p_size").cast("double").alias("as_double"), F.col("p_size").cast("string").alias("as_text"),
        F.floor("p_retailprice").cast("long").alias("as_long"), (-F.col("p_size")).alias("negative"),
    )


@query("substring", "SELECT o_orderkey, substring(o_orderpriority, 1, 4) AS s, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus || '/' || o_orderpriority AS both FROM orders")
def substring(x: Context) -> DataFrame:
    return x.t("orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 4).alias("s"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.concat("o_orderstatus", F.lit("/"), "o_orderpriority").alias("both"),
    )


_GRAMS = (
    "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), "
    "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
)
_A, _B = _GRAMS.format("p_name"), _GRAMS.format("'part name 12'")


@query(
    "trigram_similarity",
    f"SELECT p_partkey, {r5('CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END')} AS s FROM (SELECT p_partkey, {_A} AS a, {_B} AS b FROM part)",
)
def trigram(x: Context) -> DataFrame:
    return x.t("part").select("p_partkey", round5(trigram_similarity(F.col("p_name"), F.lit("part name 12"))).alias("s"))


@query("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(x: Context) -> DataFrame:
    return x.t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


_TEXT = "array_to_string(list_sort(['orders_1.o_orderstatus=' || o_orderstatus, 'customer_2.c_mktsegment>' || o_orderpriority]), ' ∧ ')"


def _pattern_texts(x: Context) -> DataFrame:
    part = lambda name, op, value: F.struct(F.lit(name).alias("name"), F.lit(op).alias("op"), F.col(value).alias("value"))
    both = F.array(part("orders_1.o_orderstatus", "=", "o_orderstatus"), part("customer_2.c_mktsegment", ">", "o_orderpriority"))
    return x.t("orders").select("o_orderkey", pattern_text(both).alias("p_desc"))


@query("pattern_text", f"SELECT o_orderkey, {_TEXT} AS p_desc FROM orders")
def pattern_texts(x: Context) -> DataFrame:
    return _pattern_texts(x)


@query(
    "pattern_triplets",
    f"SELECT o_orderkey, regexp_extract(p, '^([^=<>]+)([=<>])(.*)$', 1) AS name, regexp_extract(p, '^([^=<>]+)([=<>])(.*)$', 2) AS op, regexp_extract(p, '^([^=<>]+)([=<>])(.*)$', 3) AS value "
    f"FROM (SELECT o_orderkey, unnest(string_split({_TEXT}, ' ∧ ')) AS p FROM orders)",
)
def triplets(x: Context) -> DataFrame:
    return _pattern_texts(x).select("o_orderkey", F.explode(pattern_triplets(F.col("p_desc"))).alias("p")).select("o_orderkey", "p.*")


@query("highlight_prefixes", f"SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(string_split({_TEXT}, ' ∧ '), lambda p: split_part(p, '.', 1)))), ',') AS nodes FROM orders")
def highlight(x: Context) -> DataFrame:
    return _pattern_texts(x).select("o_orderkey", F.array_join(highlighted(F.col("p_desc")), ",").alias("nodes"))


@query("to_json_map", "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS j FROM nation")
def to_json_map(x: Context) -> DataFrame:
    return x.t("nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("j"))
