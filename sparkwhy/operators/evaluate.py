"""Studies of sampled results against full ones."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lca, sampling


def paired(truth: DataFrame, sampled: DataFrame, on: Sequence[str] = ("is_user", "jg", "p_desc"), score: str = "fscore") -> DataFrame:
    """Full outer join of two runs on what identifies a pattern; a missing score is null."""
    t = truth.select(*on, F.col(score).alias("t_score"))
    s = sampled.select(*on, F.col(score).alias("s_score"))
    return t.join(s, list(on), "full_outer")


def _tie_mean(rank_by: Column, gain: Column, name: str, frame: DataFrame) -> DataFrame:
    """Gains summed over positions, those of tied scores averaged over their positions."""
    window = Window.orderBy(rank_by.desc())
    ranked = frame.withColumn("_p", F.row_number().over(window)).withColumn("_d", 1 / F.log2(F.col("_p") + 1))
    tied = ranked.groupBy(rank_by.alias("_r")).agg(F.avg(gain).alias("g"), F.sum("_d").alias("d"))
    return tied.agg(F.sum(F.col("g") * F.col("d")).alias(name))


def ndcg(truth: DataFrame, sampled: DataFrame, on: Sequence[str] = ("is_user", "jg", "p_desc"), score: str = "fscore") -> DataFrame:
    """One row: how well the sampled scores rank the patterns by their true ones (ndcg_score).

    Patterns that one run lacks have score 0 there. The inputs are result tables, whose size the
    search bounds; they are ranked in one task.
    """
    both = paired(truth, sampled, on, score).select(F.coalesce("t_score", F.lit(0.0)).alias("t"), F.coalesce("s_score", F.lit(0.0)).alias("s"))
    got = _tie_mean(F.col("s"), F.col("t"), "dcg", both)
    best = _tie_mean(F.col("t"), F.col("t"), "ideal", both)
    return got.crossJoin(best).select((F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0))).alias("ndcg_score"))


def agreement(patterns: DataFrame, stats: DataFrame) -> DataFrame:
    """For each run its parameters and how many of its patterns the run with the largest sample has too."""
    largest = stats.orderBy(F.col("sample_size").cast("double").desc(), "exp_desc").limit(1).select(F.col("exp_desc").alias("_largest"))
    base = patterns.join(F.broadcast(largest), patterns["exp_desc"] == F.col("_largest")).select(F.col("pattern").alias("_p")).distinct()
    shared = patterns.join(base, patterns["pattern"] == F.col("_p"), "left_semi")
    counts = shared.groupBy("exp_desc").agg(F.count("*").alias("num_match"))
    return stats.join(counts, "exp_desc", "left").withColumn("num_match", F.coalesce("num_match", F.lit(0)))


def lca_study(apt_rows: DataFrame, attributes: Sequence[str], sizes: Sequence[int], most: int = 10, seed: int = 1, by: list[str] | None = None) -> DataFrame:
    """How candidates depend on the sample: for each size the time, and how many of its top patterns the largest run has too."""
    spark, runs, patterns = apt_rows.sparkSession, [], []
    rows = apt_rows.count()
    for size in sizes:
        start = time.perf_counter()
        left, right = sampling.uniform(apt_rows, size, seed, by), sampling.uniform(apt_rows, size, seed + 1, by)
        found = lca.common_values(left, right, list(attributes), most, size).collect()
        runs.append((f"sample_{size}", time.perf_counter() - start, str(min(size, rows)), rows, len(found), len(attributes)))
        patterns += [(f"sample_{size}", " ∧ ".join(f"{a}={r[a]}" for a in attributes if r[a] is not None)) for r in found]
    stats = spark.createDataFrame(runs, "exp_desc string, time double, sample_size string, apt_size long, num_result_p long, num_attrs int")
    return agreement(spark.createDataFrame(patterns, "exp_desc string, pattern string"), stats)


def ndcg_study(engine, question, edges: Sequence[int], rates: Sequence[float], settings) -> DataFrame:
    """How well sampled scores rank patterns: one row (edges, sample_rate, runtime, ndcg_score) for each setting."""
    out = []
    for e in edges:
        exact = engine.explain(question, replace(settings, max_edges=e, exact=True, score_mode="o")).tables(engine.spark)["patterns"]
        for rate in rates:
            start = time.perf_counter()
            sampled = engine.explain(question, replace(settings, max_edges=e, score_rate=rate, score_mode="s")).tables(engine.spark)["patterns"]
            taken = time.perf_counter() - start
            out.append((e, rate, taken, ndcg(exact, sampled, ["is_user", "jg_details", "p_desc"]).first()["ndcg_score"]))
    return engine.spark.createDataFrame(out, "edges int, sample_rate double, runtime double, ndcg_score double")


def only_in(first: DataFrame, second: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the first run whose key the second lacks; unlike NOT IN, nulls there hide nothing."""
    return first.join(second.select(*on).distinct(), list(on), "left_anti")


def runtime_pivot(rows: DataFrame, sizes: str = "size", rates: str = "rate", total: str = "total") -> DataFrame:
    """One row per size, one column per sample rate, and the runtime that growth in proportion would give."""
    wide = rows.groupBy(sizes).pivot(rates).agg(F.first(total))
    first = F.first(F.struct(sizes, *[c for c in wide.columns if c != sizes])).over(Window.orderBy(sizes).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rate = wide.columns[1]
    return wide.withColumn("expected", first[rate] * F.col(sizes) / F.nullif(first[sizes], F.lit(0)))


def five_numbers(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Minimum, quartiles and maximum of a value in each group, for box plots of results.

    The values of a group are counted apart before they meet, so a group's task holds its different values, as many
    as a plot is made from; ``quantiles.quantiles`` is for columns of any size.
    """
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_n"))
    made = rows.groupBy(by, value).agg(F.count("*").alias("_n")).groupBy(by).agg(F.min(value).alias("low"), q.alias("_q"), F.max(value).alias("high"))
    return made.select(by, "low", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "high")
