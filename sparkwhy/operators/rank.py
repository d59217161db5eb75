"""Rankings of patterns: global, by join graph, of the best graphs, diversified, and by feedback."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import fmean, stdev

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trigram_similarity
from .features import value_entropy
from .patterns import Described


def globally(patterns: Sequence[Described]) -> list[Described]:
    return sorted(patterns, key=lambda d: (-d.pattern.f1, d.graph_name, d.pattern.is_user, d.text))


def by_graph(patterns: Sequence[Described]) -> dict[str, list[Described]]:
    out: dict[str, list[Described]] = {}
    for d in globally(patterns):
        out.setdefault(d.graph_name, []).append(d)
    return out


GRAPH_ORDER = {
    "avg": fmean,
    "entropy": lambda scores: value_entropy(np.array(scores)),
    "stddev": lambda scores: stdev(scores) if len(scores) > 1 else 0.0,
}


def best_of_best(patterns: Sequence[Described], graphs: int = 5, each: int = 5, by: str = "entropy") -> list[Described]:
    """Top patterns of the top graphs; graphs ranked by mean, entropy or standard deviation of their F-scores."""
    groups = by_graph(patterns)
    order = sorted(groups, key=lambda g: (-round(GRAPH_ORDER[by]([d.pattern.f1 for d in groups[g]]), 9), g))
    return [d for g in order[:graphs] for d in groups[g][:each]]


def diversity(d: Described, other: Described, same_attribute: float = -0.3, same_value: float = -2.0) -> float:
    """F-score plus the mean over the pattern's parts: 1 if the other lacks the attribute, else a penalty."""
    there = dict(other.tokens)
    parts = [1.0 if a not in there else same_value if there[a] == v else same_attribute for a, v in d.tokens]
    return d.pattern.f1 + sum(parts) / len(parts)


def diversified(patterns: Sequence[Described], k: int = 10) -> list[Described]:
    """Up to ``k`` different patterns: the best first, then each time the one least like those chosen.

    The score of a pattern is its lowest against any chosen one. A chosen pattern isn't
    chosen again, and pools smaller than ``k`` are ordered whole.
    """
    pool = globally(patterns)
    if not pool:
        return []
    chosen, rest = [pool[0]], pool[1:]
    lowest = [diversity(d, pool[0]) for d in rest]
    while rest and len(chosen) < k:
        at = max(range(len(rest)), key=lambda i: lowest[i])
        chosen.append(rest.pop(at))
        lowest.pop(at)
        lowest = [min(s, diversity(d, chosen[-1])) for s, d in zip(lowest, rest, strict=True)]
    return chosen


# The same on tables of patterns, with columns graph, p_desc and fscore.


def rank_table(patterns: DataFrame, score: str = "fscore", within: str | None = None, ties: Sequence[str] = ("p_desc",)) -> DataFrame:
    """Add ``rank`` by falling score, over all patterns or within a column's groups.

    Without groups one task ranks the table: a result table, whose size the search bounds.
    """
    window = Window.partitionBy(within) if within else Window.partitionBy()
    return patterns.withColumn("rank", F.row_number().over(window.orderBy(F.col(score).desc(), *ties)).cast("long"))


def graph_scores(patterns: DataFrame, by: str = "avg", graph: str = "jg", score: str = "fscore") -> DataFrame:
    """One row per graph with the measure that ranks it."""
    if by == "entropy":
        counts = patterns.groupBy(graph, score).agg(F.count("*").alias("n"))
        totals = counts.groupBy(graph).agg(F.sum("n").alias("t"))
        return counts.join(totals, graph).groupBy(graph).agg((-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).alias("graph_score"))
    measure = F.avg(score) if by == "avg" else F.coalesce(F.stddev_samp(score), F.lit(0.0))
    return patterns.groupBy(graph).agg(measure.alias("graph_score"))


def best_of_best_table(patterns: DataFrame, graphs: int, each: int, by: str = "avg", graph: str = "jg", score: str = "fscore", ties: Sequence[str] = ("p_desc",)) -> DataFrame:
    """Top patterns of the top graphs; the list of graphs is bounded by ``graphs``, so it is broadcast."""
    order = F.round(F.col("graph_score"), 9).desc()
    top = graph_scores(patterns, by, graph, score).orderBy(order, graph).limit(graphs)
    return rank_table(patterns.join(F.broadcast(top), graph), score, graph, ties).where(F.col("rank") <= each)


def rerank(patterns: DataFrame, liked: Sequence[str], disliked: Sequence[str], most: int = 20, text: str = "p_desc", score: str = "fscore") -> DataFrame:
    """Patterns by their likeness to liked minus disliked texts, times their score. Either list may be empty."""
    total = F.lit(0.0)
    for sign, texts in ((1, liked), (-1, disliked)):
        for t in texts:
            total = total + sign * trigram_similarity(F.col(text), F.lit(t))
    base = total if liked or disliked else F.lit(1.0)
    return patterns.withColumn("likeness", base * F.col(score)).orderBy(F.col("likeness").desc(), text).limit(most)
