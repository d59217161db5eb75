"""Data behind the charts of one predicate of a pattern."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bin_width
from .patterns import Pattern


def _labelled(rows: DataFrame, pattern: Pattern, column: str, labels: tuple[str, str]) -> DataFrame:
    """Rows that all other predicates of the pattern let through, with the label of their side."""
    others = replace(pattern, nominal=tuple(x for x in pattern.nominal if x[0] != column), ordinal=tuple(x for x in pattern.ordinal if x[0] != column))
    side = F.when(F.col("is_user") == "yes", labels[0]).otherwise(labels[1]).alias("side")
    return rows.where(others.predicate()).select(side, F.col(column).alias("value"))


def nominal_counts(rows: DataFrame, pattern: Pattern, column: str, labels: tuple[str, str] = ("first", "second")) -> DataFrame:
    """How often each value of a column occurs on each side."""
    return _labelled(rows, pattern, column, labels).groupBy("side", "value").agg(F.count("*").alias("cnt"))


def histogram(rows: DataFrame, pattern: Pattern, column: str, labels: tuple[str, str] = ("first", "second")) -> DataFrame:
    """Counts of a numeric column's values in bins, on each side: side, bin (its lower edge), width, cnt."""
    values = _labelled(rows, pattern, column, labels).where("value is not null")
    edges = values.agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high")).select("low", bin_width(F.col("low"), F.col("high")).alias("width"))
    binned = values.crossJoin(F.broadcast(edges))
    at = F.col("low") + F.floor((F.col("value") - F.col("low")) / F.col("width")) * F.col("width")
    return binned.groupBy("side", at.alias("bin"), "width").agg(F.count("*").alias("cnt"))
