"""Rankings and studies of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round5
from ..operators import evaluate, rank, sampling
from . import Context, query
from .texts import SCORES, r5


def scores(x: Context) -> DataFrame:
    """Scores of made-up patterns: parts by brand (as the join graph) and type (as the pattern)."""
    grouped = x.t("part").groupBy(F.col("p_brand").alias("jg"), F.col("p_type").alias("p_desc"))
    return grouped.agg(round5(F.avg("p_size") / 100).alias("fscore"), round5(F.avg("p_retailprice") / 10000).alias("s_score"))


@query("rank_global", f"WITH {SCORES} SELECT jg, p_desc, fscore, row_number() OVER (ORDER BY fscore DESC, jg, p_desc) AS rank FROM scores")
def rank_global(x: Context) -> DataFrame:
    return rank.rank_table(scores(x), ties=("jg", "p_desc")).select("jg", "p_desc", "fscore", "rank")


@query("rank_by_jg", f"WITH {SCORES} SELECT jg, p_desc, fscore, row_number() OVER (PARTITION BY jg ORDER BY fscore DESC, p_desc) AS rank FROM scores")
def rank_by_jg(x: Context) -> DataFrame:
    return rank.rank_table(scores(x), within="jg").select("jg", "p_desc", "fscore", "rank")


def _top(measure: str) -> str:
    return (
        f"WITH {SCORES}, g AS ({measure}), top AS (SELECT jg FROM g ORDER BY round(m, 9) DESC, jg LIMIT 5) "
        "SELECT jg, p_desc, fscore, rank FROM (SELECT *, row_number() OVER (PARTITION BY jg ORDER BY fscore DESC, p_desc) AS rank FROM scores WHERE jg IN (SELECT jg FROM top)) WHERE rank <= 3"
    )


_ENTROPY = "SELECT jg, -sum(n / t * ln(n / t)) AS m FROM (SELECT jg, n, sum(n) OVER (PARTITION BY jg) AS t FROM (SELECT jg, fscore, count(*)::DOUBLE AS n FROM scores GROUP BY jg, fscore)) GROUP BY jg"


@query("topk_jg_avg", _top("SELECT jg, avg(fscore) AS m FROM scores GROUP BY jg"))
def topk_jg_avg(x: Context) -> DataFrame:
    return rank.best_of_best_table(scores(x), 5, 3, "avg").select("jg", "p_desc", "fscore", "rank")


@query("topk_jg_entropy", _top(_ENTROPY))
def topk_jg_entropy(x: Context) -> DataFrame:
    return rank.best_of_best_table(scores(x), 5, 3, "entropy").select("jg", "p_desc", "fscore", "rank")


@query("topk_jg_stddev", _top("SELECT jg, coalesce(stddev_samp(fscore), 0) AS m FROM scores GROUP BY jg"))
def topk_jg_stddev(x: Context) -> DataFrame:
    return rank.best_of_best_table(scores(x), 5, 3, "stddev").select("jg", "p_desc", "fscore", "rank")


def _grams(text: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _likeness(text: str) -> str:
    a, b = _grams("t"), _grams(f"'{text}'")
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


@query(
    "feedback_top20",
    f"WITH {SCORES}, k AS (SELECT t, fscore, ({_likeness('Brand#11 STANDARD')} - {_likeness('Brand#22 PROMO')}) * fscore AS likeness FROM (SELECT jg || ' ' || p_desc AS t, fscore FROM scores)) "
    f"SELECT t AS p_desc, fscore, {r5('likeness')} AS likeness FROM k ORDER BY likeness DESC, t LIMIT 20",
)
def feedback_top20(x: Context) -> DataFrame:
    rows = scores(x).select(F.concat_ws(" ", "jg", "p_desc").alias("p_desc"), "fscore")
    return rank.rerank(rows, ["Brand#11 STANDARD"], ["Brand#22 PROMO"]).withColumn("likeness", round5(F.col("likeness")))


@query("result_pairs", f"WITH {SCORES}, t AS (SELECT * FROM scores WHERE fscore > 0.25), s AS (SELECT * FROM scores WHERE s_score > 0.12) SELECT coalesce(t.jg, s.jg) AS jg, coalesce(t.p_desc, s.p_desc) AS p_desc, t.fscore AS t_score, s.s_score AS s_score FROM t FULL OUTER JOIN s ON t.jg = s.jg AND t.p_desc = s.p_desc")
def result_pairs(x: Context) -> DataFrame:
    truth = scores(x).where("fscore > 0.25").select("jg", "p_desc", "fscore")
    sampled = scores(x).where("s_score > 0.12").select("jg", "p_desc", F.col("s_score").alias("fscore"))
    return evaluate.paired(truth, sampled, ["jg", "p_desc"])


def _dcg(by: str) -> str:
    return f"SELECT sum(g * d) FROM (SELECT avg(fscore) AS g, sum(1 / log2(p + 1)) AS d FROM (SELECT fscore, s_score, row_number() OVER (ORDER BY {by} DESC) AS p FROM scores) GROUP BY {by})"


@query("ndcg", f"WITH {SCORES} SELECT {r5(f'({_dcg("s_score")}) / ({_dcg("fscore")})')} AS ndcg_score")
def ndcg(x: Context) -> DataFrame:
    both = scores(x)
    found = evaluate.ndcg(both.select("jg", "p_desc", "fscore"), both.select("jg", "p_desc", F.col("s_score").alias("fscore")), ["jg", "p_desc"])
    return found.select(round5(F.col("ndcg_score")).alias("ndcg_score"))


@query(
    "lca_agreement",
    "WITH p AS (SELECT DISTINCT p_brand AS exp_desc, p_type || '/' || p_size AS pattern FROM part), s AS (SELECT p_brand AS exp_desc, count(*)::VARCHAR AS sample_size FROM part GROUP BY p_brand), "
    "big AS (SELECT exp_desc FROM s ORDER BY sample_size::DOUBLE DESC, exp_desc LIMIT 1) SELECT s.exp_desc, sample_size, coalesce(n, 0) AS num_match FROM s LEFT JOIN "
    "(SELECT exp_desc, count(*) AS n FROM p WHERE pattern IN (SELECT pattern FROM p WHERE exp_desc = (SELECT exp_desc FROM big)) GROUP BY exp_desc) m ON m.exp_desc = s.exp_desc",
)
def lca_agreement(x: Context) -> DataFrame:
    part = x.t("part")
    patterns = part.select(F.col("p_brand").alias("exp_desc"), F.concat_ws("/", "p_type", "p_size").alias("pattern")).distinct()
    stats = part.groupBy(F.col("p_brand").alias("exp_desc")).agg(F.count("*").cast("string").alias("sample_size"))
    return evaluate.agreement(patterns, stats)


@query("run_diff", "SELECT DISTINCT p_type, p_size FROM part WHERE p_brand = 'Brand#11' AND (p_type, p_size) NOT IN (SELECT p_type, p_size FROM part WHERE p_brand = 'Brand#22')")
def run_diff(x: Context) -> DataFrame:
    run = lambda b: x.t("part").where(F.col("p_brand") == b).select("p_type", "p_size").distinct()
    return evaluate.only_in(run("Brand#11"), run("Brand#22"), ["p_type", "p_size"])


@query("pivot_runtime", f"SELECT o_orderpriority AS size, {', '.join(r5(f"avg(o_totalprice) FILTER (WHERE o_orderstatus = '{s}')") + f' AS {s}' for s in 'FOP')} FROM orders GROUP BY o_orderpriority")
def pivot_runtime(x: Context) -> DataFrame:
    wide = x.t("orders").groupBy(F.col("o_orderpriority").alias("size")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return wide.select("size", *[round5(F.col(s)).alias(s) for s in "FOP"])


@query(
    "expected_runtime",
    "WITH r AS (SELECT l_linenumber AS size, l_returnflag AS rate, count(*)::DOUBLE AS total FROM lineitem GROUP BY ALL), w AS (SELECT size, max(total) FILTER (WHERE rate = 'A') AS A, max(total) FILTER (WHERE rate = 'N') AS N, "
    f"max(total) FILTER (WHERE rate = 'R') AS R FROM r GROUP BY size) SELECT size, A, N, R, {r5('first_value(A) OVER (ORDER BY size) * size / first_value(size) OVER (ORDER BY size)')} AS expected FROM w",
)
def expected_runtime(x: Context) -> DataFrame:
    rows = x.t("lineitem").groupBy(F.col("l_linenumber").alias("size"), F.col("l_returnflag").alias("rate")).agg(F.count("*").cast("double").alias("total"))
    return evaluate.runtime_pivot(rows).withColumn("expected", round5(F.col("expected")))


@query("box_summary", "SELECT p_brand, min(p_size) AS low, quantile_cont(p_size, 0.25) AS q1, quantile_cont(p_size, 0.5) AS median, quantile_cont(p_size, 0.75) AS q3, max(p_size) AS high FROM part GROUP BY p_brand")
def box_summary(x: Context) -> DataFrame:
    return evaluate.five_numbers(x.t("part"), "p_brand", "p_size")


@query("stage_time_report", "SELECT n_nationkey, n_name, n_regionkey::DOUBLE + n_nationkey::DOUBLE AS check_time FROM nation")
def stage_time_report(x: Context) -> DataFrame:
    return x.t("nation").select("n_nationkey", "n_name", (F.col("n_regionkey").cast("double") + F.col("n_nationkey").cast("double")).alias("check_time"))


@query(
    "win_flag_join",
    "SELECT o_orderkey, c_name, n_name, substring(o_orderpriority, 1, 1) AS level, CASE WHEN o_totalprice > c_acctbal * 20 THEN 1 ELSE 0 END AS win FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def win_flag_join(x: Context) -> DataFrame:
    joined = x.t("orders").join(x.t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(x.t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(x.t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    win = F.when(F.col("o_totalprice") > F.col("c_acctbal") * 20, 1).otherwise(0).alias("win")
    return joined.select("o_orderkey", "c_name", "n_name", F.substring("o_orderpriority", 1, 1).alias("level"), win)


@query("ndcg_ids", f"WITH {SCORES} SELECT jg, p_desc, row_number() OVER (ORDER BY fscore, jg, p_desc) AS id, coalesce(CASE WHEN s_score > 0.12 THEN s_score END, 0) AS s_f1 FROM scores")
def ndcg_ids(x: Context) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy().orderBy("fscore", "jg", "p_desc")
    return scores(x).select("jg", "p_desc", F.row_number().over(order).cast("long").alias("id"), F.coalesce(F.when(F.col("s_score") > 0.12, F.col("s_score")), F.lit(0.0)).alias("s_f1"))
