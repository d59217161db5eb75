"""A declared catalog: tables, their attributes, primary keys and foreign keys.

Parquet carries no keys, so they are declared here rather than discovered.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NumericType

ORDINAL, NOMINAL = "ordinal", "nominal"


@dataclass(frozen=True)
class ForeignKey:
    """``child`` columns that refer to ``parent`` columns, paired by position."""

    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    @property
    def pairs(self) -> tuple[tuple[str, str], ...]:
        return tuple(zip(self.child_columns, self.parent_columns, strict=True))

    def columns_of(self, table: str) -> tuple[str, ...]:
        return self.child_columns if table == self.child else self.parent_columns

    def other(self, table: str) -> str:
        return self.parent if table == self.child else self.child

    def condition(self, child: str | None = None, parent: str | None = None) -> str:
        """Text of the equality, with names for the two sides."""
        c, p = child or self.child, parent or self.parent
        return " AND ".join(f"{p}.{y} = {c}.{x}" for x, y in self.pairs)


@dataclass(frozen=True)
class Table:
    name: str
    attributes: tuple[tuple[str, str], ...]  # (column, ordinal or nominal), in order
    primary_key: tuple[str, ...] = ()
    types: tuple[tuple[str, str], ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c for c, _ in self.attributes]

    def kind(self, column: str) -> str:
        return dict(self.attributes)[column]


def kinds(df: DataFrame) -> tuple[tuple[str, str], ...]:
    """Numeric columns are ordinal, all others nominal."""
    return tuple((f.name, ORDINAL if isinstance(f.dataType, NumericType) else NOMINAL) for f in df.schema.fields)


@dataclass
class Catalog:
    """Tables as DataFrames with their declared keys; the schema graph follows from these."""

    frames: dict[str, DataFrame]
    primary_keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()

    @classmethod
    def from_parquet(cls, spark: SparkSession, directory: str, names: list[str], primary_keys=None, foreign_keys=()) -> Catalog:
        frames = {n: spark.read.parquet(f"{directory}/{n}.parquet") for n in names}
        return cls(frames, primary_keys or {}, tuple(f for f in foreign_keys if f.child in frames and f.parent in frames))

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, names: list[str], primary_keys=None, foreign_keys=(), **options: str) -> Catalog:
        """Tables of a database server; Spark pushes filters and column lists into its scans."""
        frames = {n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load() for n in names}
        return cls(frames, primary_keys or {}, tuple(foreign_keys))

    @classmethod
    def from_csv(cls, spark: SparkSession, directory: str, names: list[str], primary_keys=None, foreign_keys=()) -> Catalog:
        frames = {n: spark.read.option("header", True).option("inferSchema", True).csv(f"{directory}/{n}.csv") for n in names}
        return cls(frames, primary_keys or {}, tuple(foreign_keys))

    @cached_property
    def tables(self) -> dict[str, Table]:
        return {n: Table(n, kinds(df), tuple(self.primary_keys.get(n, ())), tuple(df.dtypes)) for n, df in self.frames.items()}

    def frame(self, name: str) -> DataFrame:
        return self.frames[name]

    def edges_of(self, table: str) -> list[ForeignKey]:
        return [f for f in self.foreign_keys if table in (f.child, f.parent)]

    def edges_between(self, a: str, b: str) -> list[ForeignKey]:
        return [f for f in self.foreign_keys if {f.child, f.parent} == {a, b}]

    def edge_keys(self, table: str) -> set[str]:
        """Columns of a table that occur in some foreign key, on either side."""
        return {c for f in self.edges_of(table) for c in f.columns_of(table)}

    def keys(self, table: str) -> set[str]:
        """Primary key columns and all columns of foreign keys."""
        return set(self.tables[table].primary_key) | self.edge_keys(table)

    def is_mapping(self, table: str) -> bool:
        """Nothing but key columns: such a table only connects others."""
        return set(self.tables[table].columns) == self.keys(table)

    def schema_rows(self, spark: SparkSession) -> DataFrame:
        """One row per column: table, column, type, kind, whether in the primary key or in a foreign key."""
        rows = [
            (t.name, c, dict(t.types)[c], k, c in t.primary_key, c in self.edge_keys(t.name))
            for t in self.tables.values() for c, k in t.attributes
        ]
        return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, kind string, is_primary boolean, in_foreign boolean")

    def edge_rows(self, spark: SparkSession) -> DataFrame:
        """One row per foreign key: child, parent, condition."""
        return spark.createDataFrame([(f.child, f.parent, f.condition()) for f in self.foreign_keys], "child string, parent string, condition string")

    def graph_json(self) -> dict:
        """Nodes and links of the schema graph, as drawing programs take them."""
        names = sorted(self.frames)
        links = [{"source": names.index(f.child), "target": names.index(f.parent), "condition": f.condition()} for f in self.foreign_keys]
        return {"nodes": [{"id": k, "name": n} for k, n in enumerate(names)], "links": links}

    def preview(self, table: str) -> DataFrame:
        return self.frames[table].limit(1)


TPCH_KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
    "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",),
}
TPCH_FOREIGN_KEYS = tuple(
    ForeignKey(c, (x,), p, (y,))
    for c, x, p, y in (
        ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("events", "user_id", "customer", "c_custkey"),
    )
)


def star_catalog(spark: SparkSession, directory: str, names: list[str] | None = None) -> Catalog:
    """The star schema of the test tables with its keys."""
    names = names or ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    return Catalog.from_parquet(spark, directory, names, TPCH_KEYS, TPCH_FOREIGN_KEYS)
