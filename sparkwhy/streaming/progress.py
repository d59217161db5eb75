"""Progressive delivery: patterns are appended to a table graph by graph and read as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine, Explanation, Settings
from ..plans.question import Question
from ..sources import sinks


def publish(engine: Engine, question: Question, directory: str, settings: Settings = Settings(), description: str = "run") -> Explanation:
    """Run a question and append each join graph's patterns to ``patterns`` as it is done."""
    out = Explanation(question)
    for _, top in engine.explain_steps(question, settings, out):
        if top:
            sinks.append(sinks.pattern_rows(engine.spark, top, description, question.labels), directory, "patterns")
    return out


def follow(spark: SparkSession, directory: str) -> DataFrame:
    """The patterns table as a stream."""
    return spark.readStream.schema(sinks.PATTERN_SCHEMA).parquet(f"{directory}/patterns")


def progress(stream: DataFrame) -> DataFrame:
    """Join graphs and patterns so far, and the best score of each run; the state is a row per run and graph."""
    return stream.groupBy("exp_desc", "jg_name").agg(F.count("*").alias("patterns"), F.max("fscore").alias("best"))


def deliver(stream: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Call ``handle`` with the new patterns of every micro-batch until all that is there has been read."""
    return stream.writeStream.foreachBatch(lambda batch, _: handle(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
