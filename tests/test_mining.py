import math
import threading

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwhy import queries
from sparkwhy.operators import apt, features, forest, lca, provenance, quantiles, rank, refine, sampling, score
from sparkwhy.operators.features import Features
from sparkwhy.operators.patterns import Described, Pattern
from sparkwhy.plans.join_graph import enumerate_graphs
from sparkwhy.plans.question import Aggregate, Filter, Query, Question
from sparkwhy.sources.catalog import Catalog, ForeignKey


def rows(spark, data, schema="is_user string, pnumber long, a_1 string, a_2 double"):
    return spark.createDataFrame(data, schema)


def test_common_values_ignore_nulls_and_count_the_empty_set(spark):
    d = rows(spark, [("yes", 1, "x", 1.0), ("yes", 2, None, 1.0), ("no", 1, "y", 2.0)])
    found = {(r["a_1"],): r["pattern_freq"] for r in lca.common_values(d, d, ["a_1"]).collect()}
    assert found == {("x",): 1, ("y",): 1, (None,): 7}
    assert lca.candidates(d, d, ["a_1"], most=1) == []  # the empty set took the only place
    assert lca.candidates(d, d, []) == []


@pytest.mark.parametrize("size", [1600, 2600])
def test_samples_of_any_size_are_paired_whole(spark, size):
    d = spark.range(3000).select(F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("string")).alias("a_1"), (F.col("id") % 3).cast("string").alias("a_2"))
    left, right = sampling.uniform(d, size, 1), sampling.uniform(d, size, 2)
    assert sampling.lca_size(100_000, 0.05, 100, size) == size
    for rows_told in (size, None):
        found = {(r["a_1"], r["a_2"]): r["pattern_freq"] for r in lca.common_values(left, right, ["a_1", "a_2"], None, rows_told).collect()}
        assert sum(found.values()) == size * size
    x, y = ([(r["a_1"], r["a_2"]) for r in t.collect()] for t in (left, right))
    expected = {}
    for a, b in x[:40]:
        for c, e in y:
            k = (a if a is not None and a == c else None, b if b == e else None)
            expected[k] = expected.get(k, 0) + 1
    part = {(r["a_1"], r["a_2"]): r["pattern_freq"] for r in lca.common_values(spark.createDataFrame(x[:40], "a_1 string, a_2 string"), right, ["a_1", "a_2"], None).collect()}
    assert part == expected


def test_quantiles_are_exact_in_any_number_of_passes(spark):
    rng = np.random.default_rng(4)
    columns = {
        "normal": rng.normal(size=3000), "whole": rng.integers(-3, 4, 3000).astype(float), "wide": rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000),
        "same": np.full(3000, -0.0), "odd": np.where(rng.random(3000) < 0.3, np.nan, rng.choice([np.inf, -np.inf, 1.5], 3000)),
    }
    side = rng.choice(["p", "q"], 3000)
    data = [(str(side[k]), *(None if k % 10 == 0 else float(v[k]) for v in columns.values())) for k in range(3000)]
    t = spark.createDataFrame(data, "g string, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    slices = [(parts, c) for parts in ((), (("g", "=", "p"),), (("g", "=", "q"), ("whole", ">", 0.0)), (("g", "=", "none"),)) for c in columns]
    for options in ({}, {"few": 3, "buckets": 8}):
        for (parts, c), found in zip(slices, quantiles.quantiles(t, slices, **options), strict=True):
            at = [k for k in range(3000) if k % 10 and all(side[k] == v if a == "g" else columns[a][k] > v for a, _, v in parts)]
            values = np.sort([columns[c][k] for k in at if not np.isnan(columns[c][k])])
            expected = []
            for s in (0.25, 0.5, 0.75) if len(values) else ():
                place = (len(values) - 1) * s
                a, b = values[math.floor(place)], values[math.ceil(place)]
                expected.append(a if a == b else (math.ceil(place) - place) * a + (place - math.floor(place)) * b)
            assert found == expected, (parts, c)
    assert quantiles.quantiles(t, []) == []


def test_bounds_hold_nan_above_all_and_null_beside_all(spark):
    t = rows(spark, [("yes", 1, "x", float("nan")), ("yes", 2, "x", None), ("no", 1, "x", 2.0), ("no", 2, None, -1.0)])
    for op, bound in ((">", 1.0), ("<", 1.0), (">", 1e308)):
        p = Pattern(ordinal=(("a_2", op, bound),))
        expected = {s: t.where(p.predicate() & (F.col("is_user") == s)).count() for s in ("yes", "no")}
        assert score.matching_tuples(t, [p]) == score.matching_tuples(t, [p], True) == [expected]


def test_single_rows_per_tuple_need_no_shuffle(spark):
    t = rows(spark, [(("yes", "no")[k % 2], k // 2, "xyz"[k % 3], float(k % 11)) for k in range(300)])
    tried = [Pattern(nominal=(("a_1", v),), ordinal=(("a_2", ">", float(b)),)) for v in "xyz" for b in range(30)]
    assert score.sizes_and_rows(t) == ({"yes": 150, "no": 150}, 300)
    assert score.matching_tuples(t, tried, True) == score.matching_tuples(t, tried)


def test_importances_of_a_forest():
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 800).astype(float)
    x = np.stack([y + rng.normal(size=800) / 4, rng.normal(size=800), np.zeros(800), (y + (rng.random(800) < 0.2)) % 2], 1)
    found = forest.importances(x, y, trees=60)
    assert found.sum() == pytest.approx(1) and found[0] > found[3] > found[1] > found[2] == 0
    assert (forest.importances(x, y, trees=60) == found).all()
    assert forest.importances(x, np.ones(800)).sum() == 0 and forest.importances(x[:0], y[:0]).sum() == 0
    # a single split of one tree on one column: half of the rows on either side, all impurity gone
    assert forest.importances(y[:, None], y, trees=1, depth=1).tolist() == [1.0]


def test_repeated_rows_of_a_tuple_count_once_and_sides_apart(spark):
    t = rows(spark, [("yes", 1, "x", 1.0), ("yes", 1, "x", 5.0), ("yes", 2, "z", 1.0), ("no", 1, "x", 9.0), ("no", 2, None, None)])
    sizes = score.side_sizes(t)
    assert sizes == {"yes": 2, "no": 2}
    assert score.matching_tuples(t, [Pattern(nominal=(("a_1", "x"),))]) == [{"yes": 1, "no": 1}]
    (p,) = score.score(t, [Pattern(nominal=(("a_1", "x"),))], sizes)
    assert (p.recall, p.precision, p.f1) == (0.5, 0.5, 1.0 * 0.5)
    (q,) = score.score(t, [Pattern(ordinal=(("a_2", ">", 4.0),), is_user="no")], sizes)
    assert (q.recall, q.precision) == (0.5, 0.5)


def test_many_patterns_at_once_equal_one_by_one(spark):
    rng = np.random.default_rng(3)
    data = [(("yes", "no")[int(k) % 2], int(k) % 40, "abc"[int(v * 3)], float(v)) for k, v in zip(range(200), rng.random(200), strict=True)]
    t = rows(spark, data)
    tried = [Pattern(ordinal=(("a_2", op, float(b)),), is_user=s) for b in np.linspace(0, 1, 70) for op in "<>" for s in ("yes", "no")]
    found = score.matching_tuples(t, tried)
    for p, n in list(zip(tried, found, strict=True))[::41]:
        _, op, b = p.ordinal[0]
        expected = {s: len({k for u, k, _, v in data if u == s and (v > b if op == ">" else v < b)}) for s in ("yes", "no")}
        assert n == expected


def test_empty_table_scores_zero(spark):
    t = rows(spark, [])
    (p,) = score.score(t, [Pattern(nominal=(("a_1", "x"),))], score.side_sizes(t))
    assert (p.recall, p.precision, p.f1) == (0.0, 0.0, 0.0)


def test_fractional_weights(spark):
    t = rows(spark, [("yes", 1, "x", 1.0), ("yes", 1, "y", 1.0), ("yes", 2, "x", 1.0), ("no", 1, "x", 1.0)])
    ((r, p, _),) = score.score_fractional(t, [Pattern(nominal=(("a_1", "x"),))])
    assert r == 0.75 and p == pytest.approx(1.5 / 2.5)


def test_equal_quartiles_collapse_and_empty_slices_have_none(spark):
    t = rows(spark, [("yes", k, "x", 3.0) for k in range(5)] + [("no", 1, "y", None)])
    found = refine.quartiles(t, [(("a_1", "x"),), (("a_1", "y"),)], ["a_2"])
    assert found == {(("a_1", "x"),): {"a_2": [3.0]}, (("a_1", "y"),): {"a_2": []}}


def test_levelwise_search_finds_what_the_exhaustive_one_does(spark):
    rng = np.random.default_rng(5)
    t = rows(spark, [(("yes", "no")[k % 2], k, "xy"[int(rng.integers(2))], float(rng.normal(k % 2))) for k in range(120)])
    nominal = [(("a_1", "x"),), (("a_1", "y"),)]
    bounds, sizes = refine.quartiles(t, nominal, ["a_2"]), score.side_sizes(t)
    scored = lambda tried: score.score(t, tried, sizes)
    chosen = Features((("a_2", 1.0),), (("a_2", ()),), ("a_2",))
    special = {"a_1", "a_2"}
    short = refine.search(nominal, bounds, chosen, special, scored, cap=1)
    whole = refine.search_all(nominal, bounds, ["a_2"], special, scored, cap=1)
    key = lambda p: (p.nominal, p.ordinal, p.is_user, p.f1)
    assert {key(p) for p in short} == {key(p) for p in whole}
    # without the special attribute in the nominal part, a bound on it is forced
    forced = refine.search(nominal, bounds, chosen, {"a_2"}, scored, cap=1)
    assert forced and all(p.ordinal for p in forced)
    assert refine.search(nominal, bounds, Features(), {"a_9"}, scored) == []


def test_clusters_split_unrelated_variables():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=500), rng.normal(size=500)
    data = np.stack([a, a + 0.1 * rng.normal(size=500), b, b + 0.1 * rng.normal(size=500)], 1)
    assert sorted(map(sorted, features.variable_clusters(data, list("abcd")))) == [["a", "b"], ["c", "d"]]


def test_forest_ranks_the_attribute_that_separates(spark):
    rng = np.random.default_rng(2)
    t = spark.createDataFrame([(("yes", "no")[k % 2], float(k % 2 + rng.normal() / 10), float(rng.normal())) for k in range(200)], "is_user string, good double, noise double")
    chosen = features.choose(t, ["good", "noise"], {"noise"}, trees=10)
    assert chosen.ranked[0][0] == "good" and chosen.special == ("noise",)
    assert features.varying(t.withColumn("one", F.lit(1)), ["good", "one"]) == ["good"]


def described(f1, tokens, graph="jg_1", side="yes"):
    return Described(Pattern(f1=f1, is_user=side), graph, graph, 0, " ∧ ".join(a + v for a, v in tokens), tuple(tokens), ())


def test_diversification_prefers_other_attributes():
    pool = [described(0.9, [("a", "=1")]), described(0.88, [("a", "=2")]), described(0.5, [("b", "=1")]), described(0.4, [("a", ">1")])]
    assert [d.pattern.f1 for d in rank.diversified(pool, 3)] == [0.9, 0.5, 0.88]
    assert len(rank.diversified(pool, 10)) == 4 and rank.diversified([]) == []
    assert rank.diversity(pool[0], pool[0]) == pytest.approx(0.9 - 2) and rank.diversity(pool[1], pool[0]) == pytest.approx(0.88 - 0.3)


def test_best_of_best_graphs():
    pool = [described(0.9, [("a", "=1")], "g1"), described(0.9, [("b", "=1")], "g1"), described(0.5, [("a", "=1")], "g2"), described(0.4, [("b", "=1")], "g2")]
    assert {d.graph_name for d in rank.best_of_best(pool, 1, 5, "avg")} == {"g1"}
    assert {d.graph_name for d in rank.best_of_best(pool, 1, 5, "entropy")} == {"g2"}
    assert {d.graph_name for d in rank.best_of_best(pool, 1, 5, "stddev")} == {"g2"}


def test_feedback_may_be_empty(spark):
    t = spark.createDataFrame([("abc def", 0.5), ("xyz", 0.9)], "p_desc string, fscore double")
    assert [r["p_desc"] for r in rank.rerank(t, [], []).collect()] == ["xyz", "abc def"]
    assert [r["p_desc"] for r in rank.rerank(t, ["abc"], []).collect()] == ["abc def", "xyz"]


def test_samples_have_exact_sizes_and_repeat(spark):
    t = spark.range(500).withColumn("g", F.col("id") % 7).withColumn("v", F.col("id").cast("double"))
    for take in (lambda: sampling.uniform(t, 50, 3, ["id"]), lambda: sampling.weighted_by_count(t, "g", 50, 3, ["id"]), lambda: sampling.weighted_by_spread(t, "g", "v", 50, 3, ["id"])):
        first = {r["id"] for r in take().collect()}
        assert len(first) == 50 and first == {r["id"] for r in take().collect()}
    for n in (137, 499, 500, 600):
        many = sampling.first_by(t, F.col("v") % 250, n, ["id"], at_once=10, buckets=16).collect()
        assert len(many) == min(n, 500) and {r["id"] for r in many} == {k for k, _ in sorted(((k, (k % 250, k)) for k in range(500)), key=lambda x: x[1])[:n]}
    assert (sampling.lca_size(10), sampling.lca_size(10_000), sampling.lca_size(10**6)) == (100, 500, 1000)
    assert sampling.score_size(100) is None and sampling.score_size(101) == 31


def small_catalog(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "ck long, seg string")
    o = spark.createDataFrame([(10, 1, 5.0), (11, 1, 7.0), (12, 2, 1.0), (13, 3, 2.0), (14, 3, 2.0)], "ok long, ck2 long, price double")
    return Catalog({"c": c, "o": o}, {"c": ("ck",), "o": ("ok",)})


def test_provenance_with_null_groups_and_distinct_counts(spark):
    q = Query({"c": "c", "o": "o"}, ("c.seg",), (Aggregate("n", "count"), Aggregate("p", "avg", "price"), Aggregate("d", "count_distinct", "price")), (("c.ck", "o.ck2"),))
    full = {r["prov_o_ok"]: (r["seg"], r["n"], r["p"], r["d"]) for r in provenance.provenance_full(small_catalog(spark), q).collect()}
    assert full[10] == ("a", 2, 6.0, 2) and full[13] == (None, 2, 2.0, 1) and len(full) == 5
    assert {tuple(r) for r in q.result(small_catalog(spark)).collect()} == {("a", 2, 6.0, 2), ("b", 1, 1.0, 1), (None, 2, 2.0, 1)}


def test_complement_is_not_of_the_whole_predicate(spark):
    q = Query({"c": "c", "o": "o"}, ("c.seg", "o.price"), (Aggregate("n", "count"),), (("c.ck", "o.ck2"),), (Filter("o", "price", ">", 0.0),))
    question = Question(q, {"seg": "a", "price": 5.0})
    pt = provenance.provenance_table(small_catalog(spark), question)
    assert {(r["is_user"], r["prov_o_ok"]) for r in pt.collect()} == {("yes", 10), ("no", 11), ("no", 12), ("no", 13), ("no", 14)}


def test_numbering_equals_a_window(spark):
    t = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 3 == 0, "yes").otherwise("no").alias("is_user"))
    numbered, sizes = provenance.number_rows(t, ["k"])
    a = numbered.collect()
    assert sizes == {"yes": 334, "no": 666}
    b = t.withColumn("pnumber", F.row_number().over(Window.partitionBy("is_user").orderBy("k")).cast("long")).collect()
    assert {tuple(r.asDict()[c] for c in ("is_user", "k", "pnumber")) for r in a} == {tuple(r.asDict()[c] for c in ("is_user", "k", "pnumber")) for r in b}


def test_counts_of_joined_tables_equal_those_of_their_rows(spark):
    c = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, None, "a"), (4, 2, None), (5, 9, "b"), (6, 1, "a")], "ck long, nk int, seg string")
    o = spark.createDataFrame([(k, k % 7, k % 4 or None, float(k % 3)) for k in range(40)], "ok long, ck2 long, alt long, price double")
    n = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (None, "z"), (3, "w")], "nk2 long, name string")
    keys = [ForeignKey("c", ("nk",), "n", ("nk2",)), ForeignKey("o", ("ck2",), "c", ("ck",)), ForeignKey("o", ("alt",), "c", ("ck",))]
    catalog = Catalog({"c": c, "o": o, "n": n}, {"c": ("ck",), "o": ("ok",)}, keys)
    q = Query({"c": "c", "o": "o"}, ("c.seg",), (Aggregate("n", "count"),), (("c.ck", "o.ck2"),))
    pt = provenance.provenance_table(catalog, Question(q, {"seg": "a"}, {"seg": "b"}))
    all_graphs = enumerate_graphs(catalog, ("c", "o"), 3)
    graphs = [next(g for g in all_graphs if g.labels == labels) for labels in (("PT", "n", "c", "n"), ("PT", "n", "c", "o"), ("PT", "c", "n", "o"))]
    graphs.append(next(g for g in all_graphs if len(g.edges) == 3 and len(g.labels) == 3 and "o" in g.labels))  # a second edge between two nodes
    for g in graphs:
        table = apt.build(catalog, q, pt, provenance.roles(catalog, q), g)
        shown = {"PT": "alt", "c": "ck", "o": "price", "n": "name"}
        names = [next(a.name for a in table.attributes if (a.node, a.column) == (k, shown[x])) for k, x in enumerate(g.labels)]
        rows = table.rows.select("is_user", "pnumber", *names).collect()
        for by in ("is_user", names[0]):
            expected = {}
            for v in {r[by] for r in rows}:
                mine = [r for r in rows if r[by] == v]
                expected[v] = (len(mine), *(len({r[x] for r in mine} - {None}) for x in ("pnumber", *names)))
            found = apt.counts(table, by, {f"d{k}": x for k, x in enumerate(("pnumber", *names))}).collect()
            assert {r[0]: tuple(r)[1:] for r in found} == expected and len(found) == len(expected), g.text()


def test_joined_tables_are_counted_without_their_rows(spark, sf, tmp_path):
    """200 000 tuples and 40 000 customers of one nation are 8 billion rows; jobs that make them are cancelled."""
    for t in "region nation supplier part lineitem".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    segment = F.when(F.col("id") % 2 == 0, "BUILDING").otherwise("MACHINERY")
    spark.range(40_000).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_name"), F.lit(3).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"), segment.alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    order = [F.col("id").alias("o_orderkey"), (F.col("id") % 40_000).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority")]
    spark.range(200_000).select(*order).write.parquet(str(tmp_path / "orders.parquet"))
    queries.load()
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        found = queries.QUERIES["apt_second_instance"](spark, str(tmp_path)).collect()
    finally:
        late.cancel()
    assert sorted(map(tuple, found)) == [(side, 100_000 * 40_000, 100_000, 40_000) for side in ("no", "yes")]
