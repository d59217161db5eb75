"""Candidate nominal patterns: what pairs of sampled rows have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patterns import Pattern
from .score import matching_tuples, side_sizes

_BROADCAST_ROWS = 20_000


def common_values(left: DataFrame, right: DataFrame, attributes: list[str], most: int | None = 30, sample_rows: int | None = None) -> DataFrame:
    """The most frequent sets of values that pairs of rows share, with their frequency; all of them if ``most`` is None.

    For each pair, attributes that agree keep their value and others are null, nulls
    never agreeing. Equal rows of a sample are paired once, with their numbers multiplied, so the work follows the
    different rows of samples of any size. If ``sample_rows`` says that the samples are small, one is broadcast. Ties
    are ordered by the values.
    """
    a = left.groupBy(*attributes).agg(F.count("*").alias("_n"))
    b = right.groupBy(*attributes).agg(F.count("*").alias("_m")).select("_m", *[F.col(a).alias(f"_{a}") for a in attributes])
    pairs = a.crossJoin(F.broadcast(b) if sample_rows is not None and sample_rows <= _BROADCAST_ROWS else b)
    cells = [F.when(F.col(a) == F.col(f"_{a}"), F.col(a)).alias(a) for a in attributes]
    counted = pairs.select(*cells, (F.col("_n") * F.col("_m")).alias("_pairs")).groupBy(*attributes).agg(F.sum("_pairs").alias("pattern_freq"))
    if most is None:
        return counted
    return counted.orderBy(F.col("pattern_freq").desc(), *[F.col(a).asc_nulls_last() for a in attributes]).limit(most)


def candidates(left: DataFrame, right: DataFrame, attributes: list[str], most: int = 30, sample_rows: int | None = None) -> list[tuple[tuple[str, object], ...]]:
    """Non-empty sets of (attribute, value); the empty one takes one of the ``most`` places first."""
    if not attributes:
        return []
    rows = common_values(left, right, attributes, most, sample_rows).collect()
    made = [tuple((a, r[a]) for a in attributes if r[a] is not None) for r in rows]
    return [m for m in made if m]


Candidate = tuple[tuple[str, object], ...]


def recalls(rows: DataFrame, found: list[Candidate], sizes: dict[str, int] | None = None, single: bool = False) -> list[tuple[Candidate, int, float]]:
    """Candidates with the tuples of both sides that they match and their share of all, most first, then by their text."""
    if not found:
        return []
    total = sum((sizes or side_sizes(rows)).values())
    counts = matching_tuples(rows, [Pattern(nominal=f) for f in found], single)
    ranked = sorted(((f, n["yes"] + n["no"]) for f, n in zip(found, counts, strict=True)), key=lambda x: (-x[1], str(x[0])))
    return [(f, n, n / total if total else 0.0) for f, n in ranked]


def by_recall(rows: DataFrame, found: list[Candidate], least: float, most: int = 10, sizes: dict[str, int] | None = None, single: bool = False) -> list[tuple[Candidate, float]]:
    """The ``most`` candidates that match most tuples of both sides, then those of them that reach ``least``."""
    return [(f, r) for f, n, r in recalls(rows, found, sizes, single)[:most] if n and r >= least]
