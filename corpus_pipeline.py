"""The corpus pipeline: quality rules, quality classifier, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept,
and returns a table. All but the last return the columns of ``documents``, each row as it came: the
rules' line removal decides which documents are depleted, and the texts stay whole.

Rows are told apart by id and content. Of rows with equal or null ids each has its own verdict; a null or empty
text fails the rules, and no later stage removes it for that; an empty table gives an empty
result at every stage; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwhy.llm import minhash, packing, quality_model, quality_rules
from sparkwhy.llm.common import pick, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep. Repeated rows share their verdict."""
    return quality_rules.keep_good(pick(docs, *COLUMNS))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose predicted quality is 1, learnt from the labels of those here.

    A null text scores as an empty one, a score of just one half is kept. Without labels of both kinds
    all rows get the share of label 1 as their score, or 1 if there are none.
    """
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.keep_predicted(pick(docs, *COLUMNS), model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, nulls last, then the smallest hash of its text.

    Of equal rows one stays. Rows without words are in no group and all stay.
    """
    return minhash.keep_one(pick(docs, *COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in packed sequences; a null text is the end id alone, repeated rows get places of their own."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("MinHash near-dedup", near_dedup), ("best-fit packing", pack)]

#: The classifier's verdicts are no SQL; the tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's table is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
