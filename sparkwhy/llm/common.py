"""What the operators of this subpackage share: column picking and written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.written import written

#: Rows of one Arrow batch. Texts can be long, so batches hold few rows.
BATCH_ROWS = 256


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name; others may clash with them in case or with ours.

    A name that the table has twice means its first column.
    """
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"_in{i}" for i in range(len(df.columns))]).select(
        *[F.col(f"_in{i}").alias(n) for i, n in zip(at, names, strict=True)]
    )


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers of this session receive; one value, so the order of calls is no matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Tables written to the shared folder, which end a lineage and survive lost executors.
stored = written


def row_hash(*names: str) -> Column:
    """A hash of columns that tells nulls apart from other values."""
    return F.xxhash64(*[x for n in names for x in (F.col(n).isNull(), F.col(n))])


def without(docs: DataFrame, gone: DataFrame, id_col: str, hashed: tuple[str, ...], rows: int = 200_000) -> DataFrame:
    """Rows of ``docs`` whose id, which may be null, and hash of the ``hashed`` columns are no (id, row_hash) of ``gone``.

    So rows that share an id but not their content are told apart. What goes is broadcast if a count
    shows that it is small, so that texts stay where they are; else both sides are shuffled.
    """
    gone = bounded_broadcast(stored(gone.select(F.col("id").alias("_id"), F.col("row_hash").alias("_hash")).distinct(), "rejected"), rows)
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(gone["_id"]) & (row_hash(*hashed) == gone["_hash"]), "left_anti")


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``broadcast`` only if a count shows at most ``rows`` rows; else Spark's own choice."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
