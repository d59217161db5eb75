"""Numeric expressions with the same value in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round5(x: Column) -> Column:
    """Five digits, halves up; built from floor, as engines round doubles differently."""
    return F.floor(x * 100000 + 0.5) / 100000


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def recall(tp: Column, side: Column) -> Column:
    """Found tuples of a side over all of its tuples, to five digits."""
    return round5(ratio(tp.cast("double"), side))


def precision(tp: Column, found: Column) -> Column:
    return ratio(tp.cast("double"), found)


def f_score(p: Column, r: Column) -> Column:
    """Twice the rounded p * r / (p + r); 0 where that is null."""
    return F.coalesce(2 * round5(ratio(p * r, p + r)), F.lit(0.0))


def coefficient_of_variation(x: Column) -> Column:
    return F.stddev_samp(x) / F.nullif(F.avg(x), F.lit(0))


def entropy_of(counts: Column, total: Column) -> Column:
    """Natural-log entropy from one count per value."""
    return -F.sum(counts / total * F.log(counts / total))


def bin_width(low: Column, high: Column) -> Column:
    """Width of histogram bins: 1 for ranges above 1, else 0.1."""
    return F.when(F.abs(high - low) > 1, 1.0).otherwise(0.1)
