"""Provenance of a query's output rows, and the two sides of a question."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.question import Query, Question, Roles
from ..sources.catalog import NOMINAL, Catalog
from ..sources.written import discard, written


def provenance_name(relation: str, column: str) -> str:
    """``prov_<relation>_<column>``, underscores inside the names doubled."""
    return f"prov_{relation.replace('_', '__')}_{column.replace('_', '__')}"


def relation_names(query: Query) -> dict[str, str]:
    """A name for each alias: its table, numbered from the second instance on."""
    out, seen = {}, {}
    for alias, table in query.tables.items():
        n = seen[table] = seen.get(table, -1) + 1
        out[alias] = table if n == 0 else f"{table}_{n}"
    return out


def provenance_full(catalog: Catalog, query: Query) -> DataFrame:
    """Every output row beside every input row that it was made from.

    Groups are aggregated first, combined before the shuffle, and written: there are few, so the join
    back to the input rows is a broadcast by their known size. Input rows are not
    shuffled by group, as few groups, or one large one, would leave most machines idle. Null
    groups are equal.
    """
    names = relation_names(query)
    spj = query.joined(catalog)
    keys = [g.split(".")[1] for g in query.group_by]
    groups = spj.groupBy(*[F.col(g).alias(f"_{k}") for g, k in zip(query.group_by, keys, strict=True)]).agg(*[a.column().alias(a.name) for a in query.aggregates])
    groups = written(groups, "groups")
    on = F.lit(True)
    for g, k in zip(query.group_by, keys, strict=True):
        on = on & F.col(g).eqNullSafe(groups[f"_{k}"])
    outputs = [F.col(g).alias(k) for g, k in zip(query.group_by, keys, strict=True)] + [groups[a.name] for a in query.aggregates]
    inputs = [F.col(f"{alias}.{c}").alias(provenance_name(names[alias], c)) for alias, table in query.tables.items() for c in catalog.tables[table].columns]
    return query.joined(catalog).join(groups, on).select(*outputs, *inputs)


def roles(catalog: Catalog, query: Query) -> Roles:
    """Kinds, origins and uses of the provenance table's columns.

    Output columns and the added is_user and pnumber are nominal and not mined.
    """
    made, names, user = Roles(), relation_names(query), query.user_attributes()
    for c in [*query.outputs(), "is_user", "pnumber"]:
        made.kinds[c] = NOMINAL
        made.user.add(c)
    for alias, table in query.tables.items():
        for column, kind in catalog.tables[table].attributes:
            name = provenance_name(names[alias], column)
            made.kinds[name], made.origin[name] = kind, (names[alias], column)
            if column in catalog.keys(table):
                made.keys.add(name)
            elif (table, column) in user:
                made.user.add(name)
    return made


def order_columns(catalog: Catalog, query: Query) -> list[str]:
    """Provenance columns that tell rows apart: declared primary keys, else all columns of a table."""
    names = relation_names(query)
    return [provenance_name(names[a], c) for a, t in query.tables.items() for c in (catalog.tables[t].primary_key or catalog.tables[t].columns)]


def sides(full: DataFrame, question: Question) -> DataFrame:
    """Rows of the two sides, marked by ``is_user`` yes or no, in one pass; a row may be in both."""
    first, second = question.side(True), question.side(False)
    marks = F.array_compact(F.array(F.when(first, F.lit("yes")), F.when(second, F.lit("no"))))
    return full.where(first | second).withColumn("is_user", F.explode(marks))


def number_rows(rows: DataFrame, order: list[str], side: str = "is_user", name: str = "pnumber") -> tuple[DataFrame, dict[str, int]]:
    """Number the rows of each side from 1 in the given order, without a window over a whole side; also their numbers.

    Rows are ranged over partitions in order; each counts its own, and the counts of the
    partitions before, a row per partition and side, are added. The rows are written first, as ranging
    reads them once for a sample of the order columns and once more to deal them.
    """
    rows = written(rows, "sides")
    ranged = rows.repartitionByRange(F.col(side), *[F.col(c).asc_nulls_first() for c in order])
    ranged = ranged.sortWithinPartitions(side, *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    discard(rows)
    counts = sorted(ranged.groupBy(side, "_part").agg(F.count("*"), F.min("_at")).collect())  # as many as partitions and sides
    starts, sizes = [], Counter()
    for s, part, n, first in counts:
        starts.append((s, part, sizes[s] + 1 - first))
        sizes[s] += n
    offsets = ranged.sparkSession.createDataFrame(starts, f"{side} string, _part int, _start long")
    numbered = ranged.join(F.broadcast(offsets), [side, "_part"]).withColumn(name, F.col("_at") + F.col("_start"))
    return numbered.select(name, *rows.columns), dict(sizes)


def provenance_table(catalog: Catalog, question: Question) -> DataFrame:
    """``pnumber``, ``is_user``, output columns and provenance columns of both sides."""
    return sized_table(catalog, question)[0]


def sized_table(catalog: Catalog, question: Question) -> tuple[DataFrame, dict[str, int]]:
    """The provenance table and how many tuples each side has."""
    full = provenance_full(catalog, question.query)
    rows = sides(full, question)
    numbered, sizes = number_rows(rows, order_columns(catalog, question.query))
    discard(full)
    return numbered.select("pnumber", "is_user", *[c for c in rows.columns if c != "is_user"]), {"yes": 0, "no": 0} | sizes


def group_sizes(pt: DataFrame) -> DataFrame:
    """Distinct tuples of each side."""
    return pt.groupBy("is_user").agg(F.count_distinct("pnumber").alias("tuples"))
