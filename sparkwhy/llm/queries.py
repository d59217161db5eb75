"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_chunks import bpe_encode
from .embeddings import near_vectors
from .exact_sql import ARCHIVED, NEAR_VECTORS
from .exact_sql import near_duplicates as near_duplicates_sql
from .html_text import extract_text
from .language import identify_held_out
from .minhash import near_duplicates
from .packing import pack_documents
from .quality_model import score_held_out
from .quality_rules import quality_rules
from .quality_rules_sql import RULES
from .url_filter import judge, made_labels
from .url_filter import train as train_urls
from .warc import archived


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), train_urls(made_labels(spark)), URL_RULES)


def op2_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(table(spark, sf_dir, "documents"))
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *digests)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(table(spark, sf_dir, "documents"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op8_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_boosted_urls": op1_boosted_urls,
    "op2_bpe_chunks": op2_bpe_chunks,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_minhash_bayes": op4_minhash_bayes,
    "op5_output_codes": op5_output_codes,
    "op6_multi_index": op6_multi_index,
    "op7_content_addressed_warc": op7_content_addressed_warc,
    "op8_tag_path_ratios": op8_tag_path_ratios,
    "op9_random_indexing": op9_random_indexing,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op4_minhash_bayes": near_duplicates_sql(3, 85),
    "op6_multi_index": NEAR_VECTORS,
    "op7_content_addressed_warc": ARCHIVED,
    "op10_quality_rules": RULES,
}
