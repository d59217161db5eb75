"""Result tables: patterns, their rankings, statistics."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..operators.patterns import Described, shown_value

PATTERN_SCHEMA = (
    "id long, exp_time timestamp, exp_desc string, is_user string, jg string, jg_details string, jg_name string, num_edges int, p_desc string, "
    "recall double, precision double, fscore double, sample_recall double, sample_precision double, sample_f1 double, "
    "user_question_map string, pattern_attr_mappings string"
)
RESULT_TABLES = ("patterns", "global_results", "topk_patterns_from_top_jgs")


def pattern_rows(spark: SparkSession, patterns: Sequence[Described], description: str, labels: tuple[str, str], when: datetime | None = None) -> DataFrame:
    """A table of patterns; ids follow the given order."""
    when = when or datetime.now(timezone.utc).replace(tzinfo=None)
    rows = []
    for k, d in enumerate(patterns, 1):
        p = d.pattern
        mapping = {a: shown_value(v) for a, v in p.nominal} | {f"{a}{op}": c for a, op, c in p.ordinal}
        rows.append((
            k, when, description, labels[0] if p.is_user == "yes" else labels[1], d.graph_text.split(" | ")[0], d.graph_text, d.graph_name, d.num_edges,
            d.text, p.recall, p.precision, p.f1, p.sample_recall, p.sample_precision, p.sample_f1,
            json.dumps({"yes": labels[0], "no": labels[1]}), json.dumps(mapping),
        ))
    return spark.createDataFrame(rows, PATTERN_SCHEMA)


def append(df: DataFrame, directory: str, table: str) -> None:
    """Append rows to a Parquet table under a result directory."""
    df.write.mode("append").parquet(str(PurePosixPath(directory) / table) if "://" not in directory else f"{directory.rstrip('/')}/{table}")


def save(df: DataFrame, database: str, table: str) -> None:
    """Append rows to a table of the session's catalog, whose database is made if missing."""
    df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    df.write.mode("append").saveAsTable(f"{database}.{table}")


def drop_views(spark: SparkSession, prefix: str) -> list[str]:
    """Drop the session's temporary views whose names start with a prefix; returns their names."""
    names = [t.name for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith(prefix)]
    for n in names:
        spark.catalog.dropTempView(n)
    return names
