"""Uniform and weighted samples of exact size, repeatable by seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lca_size(rows: int, rate: float = 0.05, least: int = 100, most: int = 1000) -> int:
    return max(min(math.ceil(rows * rate), most), least)


def score_size(rows: int, rate: float = 0.3, least: int = 100) -> int | None:
    """Size of the sample on which patterns are scored; None for small tables, which are taken whole."""
    return math.ceil(rows * rate) if rows > least else None


def hash_order(seed: int, *columns: str) -> Column:
    """An order that looks random and is the same in any engine: md5 of the seed and the columns' texts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def _unit(rows: DataFrame, seed: int, by: list[str] | None) -> Column:
    """A number from 0 to 1 for each row: from the md5 order of ``by``, else from a hash of the whole row.

    Unlike random numbers, it is the same whenever and wherever a row is read again.
    """
    if by:
        return F.conv(F.substring(hash_order(seed, *by), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(2**40)) / F.lit(2.0**40)


def first_by(rows: DataFrame, value: Column, n: int, ties: list[str] | None = None, at_once: int = 1000, buckets: int = 65_536, bounds: tuple[float, float] | None = None) -> DataFrame:
    """The ``n`` rows with the smallest values, nulls last, in no particular order.

    A few are sorted out directly. For more, a histogram of the values, whose size is
    bounded, tells up to which bucket rows are taken whole; only the bucket on the
    edge is sorted, so no task sorts or gathers the sample. ``bounds`` tells the range of values if it is known.
    """
    if n <= at_once:
        return rows.orderBy(value.asc_nulls_last(), *(ties or [])).limit(n)
    valued = rows.withColumn("_value", value.cast("double"))
    low, high = bounds or valued.agg(F.min("_value"), F.max("_value")).first()
    width = (high - low) / (buckets - 1) if low is not None and high > low else 1.0
    placed = valued.withColumn("_bucket", F.coalesce(F.floor((F.col("_value") - F.lit(low)) / F.lit(width)), F.lit(buckets)))
    counts, taken = sorted(placed.groupBy("_bucket").count().collect()), 0
    if sum(count for _, count in counts) <= n:
        return rows
    for bucket, count in counts:
        if taken + count > n:
            break
        taken += count
    whole = placed.where(F.col("_bucket") < bucket)
    edge = placed.where(F.col("_bucket") == bucket).orderBy(F.col("_value").asc_nulls_last(), *(ties or [])).limit(n - taken)
    return whole.unionByName(edge).drop("_value", "_bucket")


def uniform(rows: DataFrame, n: int, seed: int = 1, by: list[str] | None = None) -> DataFrame:
    """``n`` rows by a hash of the columns ``by``, or of the whole row."""
    if by and n <= 10_000:
        return rows.orderBy(hash_order(seed, *by)).limit(n)
    return first_by(rows, _unit(rows, seed, by), n, by, bounds=(0.0, 1.0))


def weighted_by_count(rows: DataFrame, column: str, n: int, seed: int = 1, by: list[str] | None = None) -> DataFrame:
    """``n`` rows, those with frequent values of ``column`` more likely: largest random number times frequency.

    Rows whose value is null have no frequency and are left out. The frequencies
    are counted before they are joined, so no task holds all rows of a value.
    """
    return _weighted(rows, column, F.count("*"), n, seed, by)


def weighted_by_spread(rows: DataFrame, column: str, measure: str, n: int, seed: int = 1, by: list[str] | None = None) -> DataFrame:
    """As ``weighted_by_count``, times the coefficient of variation of ``measure`` among rows of the value."""
    return _weighted(rows, column, F.count("*") * (F.stddev_samp(measure) / F.nullif(F.avg(measure), F.lit(0))), n, seed, by)


def _weighted(rows: DataFrame, column: str, weight: Column, n: int, seed: int, by: list[str] | None) -> DataFrame:
    weights = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(weight.alias("_weight"))
    joined = rows.withColumn("_unit", _unit(rows, seed, by)).join(weights, rows[column] == F.col("_v"))
    return first_by(joined, -(F.col("_unit") * F.col("_weight")), n, by).drop("_v", "_weight", "_unit")


def widest(rows: DataFrame, columns: list[str]) -> str:
    """The column with most distinct values, about; the last by name of equal ones."""
    counts = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    return max(columns, key=lambda c: (counts[c], c))


def most_varying(rows: DataFrame, columns: list[str]) -> str | None:
    """The column with the highest coefficient of variation; None if no column has one."""
    spread = rows.agg(*[F.abs(F.stddev_samp(c) / F.nullif(F.avg(c), F.lit(0))).alias(c) for c in columns]).first()
    found = [c for c in columns if spread[c] is not None]
    return max(found, key=lambda c: (spread[c], c), default=None)
