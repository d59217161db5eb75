"""Registered queries, each with SQL that computes the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..plans.question import Aggregate, Query, Question
from ..sources.catalog import Catalog, star_catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Orders by market segment, and why two segments differ: the question that most queries are about.
SEGMENT_QUERY = Query(
    {"customer": "customer", "orders": "orders"}, ("customer.c_mktsegment",), (Aggregate("n_orders", "count"),), (("customer.c_custkey", "orders.o_custkey"),)
)
SEGMENTS = Question(SEGMENT_QUERY, {"c_mktsegment": "BUILDING"}, {"c_mktsegment": "MACHINERY"}, ("BUILDING", "MACHINERY"))


class Context:
    """The tables of one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def catalog(self) -> Catalog:
        return star_catalog(self.spark, self.directory)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of a ``Context`` under a name, with its SQL."""

    def register(f: Callable[[Context], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, directory: f(Context(spark, directory))
        if sql:
            SQL[name] = sql
        return f

    return register


def load() -> None:
    from . import explain, relational, results  # noqa: F401
