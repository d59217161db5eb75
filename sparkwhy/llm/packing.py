"""Best-fit packing of documents into sequences, by exact complements first."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import pick, small_batches, stored
from .tokenizing import default_path, load


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, its end id included.

    Only longer documents are cut; their first piece may be shorter than the others.
    Returns id, piece, start, length, ids_crc32 and, if asked for, ids (binary). A null
    text counts as empty and makes one piece of the end id alone.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(path).encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                bounds = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    raw = ids[a:b].tobytes()
                    rows.append((doc, k, a, b - a, zlib.crc32(raw), raw if with_ids else None))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
    source = pick(docs, id_col, text_col).select(F.col(id_col).cast("long"), text_col)
    made = source.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, ids binary").withColumnRenamed("id", id_col)
    return made if with_ids else made.drop("ids")


class SumIndex:
    """Available lengths by what one, two or three of them sum to.

    Singles are the counts themselves. Pairs stand in a table from their sum to the pairs, most
    even first; a triple's sum is found as a length and the sum of a pair no longer than it.
    Counts only fall, so pairs that have run out are dropped for good.
    """

    def __init__(self, left: np.ndarray):
        self.left, self.pairs = left, {}
        there = np.flatnonzero(left).tolist()
        for b in reversed(there):  # b <= a; the most even pair of a sum comes last
            for a in reversed(there):
                if a < b:
                    break
                if a + b < len(left):
                    self.pairs.setdefault(a + b, []).append((a, b))
        for found in self.pairs.values():
            found.sort(reverse=True)

    def one(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.left[total] else None

    def two(self, total: int, longest: int | None = None) -> tuple[int, ...] | None:
        found, left = self.pairs.get(total, ()), self.left
        for k in range(len(found) - 1, -1, -1):
            a, b = found[k]
            if longest is not None and a > longest:
                return None
            if left[a] and left[b] and (a != b or left[a] > 1):
                return a, b
            if k == len(found) - 1 and (a not in self.held and b not in self.held):
                found.pop()
        return None

    def three(self, total: int) -> tuple[int, ...] | None:
        for a in range((total + 2) // 3, total - 1):
            if self.left[a]:
                with self.holding(a):
                    rest = self.two(total - a, a)
                if rest:
                    return a, *rest
        return None

    held: tuple[int, ...] = ()

    @contextmanager
    def holding(self, length: int) -> Iterator[None]:
        """One piece of this length is spoken for meanwhile."""
        self.left[length] -= 1
        self.held = (*self.held, length)
        yield
        self.held = self.held[:-1]
        self.left[length] += 1


def _exact(left: np.ndarray, capacity: int) -> Iterator[tuple[int, tuple[int, ...], int]]:
    """(parts in the complement, lengths, how often) of sequences that are exactly full, taken off ``left``."""
    index = SumIndex(left)
    for kind, complement in enumerate((index.one, index.two, index.three), 1):
        for length in range(capacity - 1, 0, -1):
            while left[length]:
                with index.holding(length):
                    found = complement(capacity - length)
                if not found:
                    break
                parts = (length, *found)
                times = min(int(left[p]) // parts.count(p) for p in set(parts))
                for p in set(parts):
                    left[p] -= times * parts.count(p)
                yield kind, parts, times


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest pieces first, each into the fullest sequence that still holds it."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            gap = min((g for g, held in bins.items() if g >= length and held), default=None)
            if gap is None:  # one new sequence for each group of pieces that fits in one
                each = capacity // length
                full, rest = divmod(todo, each)
                for k, times in ((each, full), (rest, 1)):
                    if k and times:
                        bins.setdefault(capacity - k * length, []).append(((length,) * k, times))
                break
            parts, times = bins[gap].pop()
            used = min(times, todo)
            if used < times:
                bins[gap].append((parts, times - used))
            bins.setdefault(gap - length, []).append(((*parts, length), used))
            todo -= used
    return [x for held in bins.values() for x in held]


def plan(counts: np.ndarray, capacity: int, stops: int = 24) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many such sequences) for the counts of lengths 0..capacity.

    The gap beside a piece is looked up in the index of sums, longest pieces first: all single
    complements are consumed, for as many pieces at once as counts allow, then pairs, then triples.
    (Putting two pieces that fill a sequence together never costs one.) As pairs and triples
    use up short pieces, they end where what is left would starve: of ``stops`` points, at the last from
    which exact and best-fit sequences together are fewest. What is left is placed best fit.
    The work and the size of the plan depend on the capacity alone, not on the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    full, left[capacity] = int(left[capacity]), 0
    after = left.copy()
    made = list(_exact(after, capacity))
    least = sum(kind == 1 for kind, *_ in made)
    points, at, best = {int(k) for k in np.linspace(least, len(made), stops)}, 0, None
    for k in range(len(made) + 1):
        if k in points:
            rest = _best_fit(left, capacity)
            total = at + sum(n for _, n in rest)
            if best is None or total <= best[0]:
                best = total, k, rest
        if k < len(made):
            _, parts, times = made[k]
            at += times
            for p in parts:
                left[p] -= times
    _, k, rest = best
    return ([((capacity,), full)] if full else []) + [(parts, times) for _, parts, times in made[:k]] + rest


def _slots(made: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length its places: from rank ``first`` on, ranks go to sequences from ``sequence`` on, at ``offset``."""
    rows, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for parts, times in made:
        offset = 0
        for p in parts:
            rows.append((p, taken[p], sequence, offset))
            taken[p] += times
            offset += p
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"from": np.searchsorted(table[:, 0], np.arange(capacity + 2)), "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, capacity: int = 1024, key: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length") -> DataFrame:
    """Add sequence_id and offset to pieces with lengths from 1 to ``capacity``.

    ``pieces`` is read twice and so should be a written table. Only the count of each
    length reaches the driver. Pieces of one length are told apart by their rank, found
    from ranks inside hashed buckets and the counts of the buckets before, so that no
    task holds all pieces of a length. Ties in ``key``, repeated rows among them, get different
    places; nulls in ``key`` are values like others. A row whose length is null or not
    from 1 to ``capacity`` has no place: sequence_id and offset are null. An empty table gives
    an empty result.
    """
    spark = pieces.sparkSession
    length = F.col(length_col)
    none = [F.lit(None).cast("long").alias(n) for n in ("sequence_id", "offset")]
    odd = pieces.where(length.isNull() | (length < 1) | (length > capacity)).select("*", *none)  # the scan's statistics rule it out
    pieces = pieces.where(length.between(1, capacity))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*key, length_col), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("_bucket", length_col).agg(F.count("*").alias("_n"))
    counts = stored(counts, "length-counts")
    total = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy(length_col).agg(F.sum("_n")).collect():
        total[length] = n
    slots = spark.sparkContext.broadcast(_slots(plan(total, capacity), capacity))
    before = counts.select("_bucket", length_col, (F.sum("_n").over(Window.partitionBy(length_col).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket", length_col).orderBy(*key)).cast("long") - 1
    ranked = dealt.repartition(buckets, "_bucket", length_col).withColumn("_rank", inside).join(before, ["_bucket", length_col])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    at, names = len(pieces.columns), [*pieces.columns, "sequence_id", "offset"]
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        for batch in batches:
            lengths, ranks = batch.column(names.index(length_col)).to_numpy(), batch.column(at).to_numpy()
            entry = np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                rows, a, b = lengths == length, s["from"][length], s["from"][length + 1]
                entry[rows] = a + np.searchsorted(s["first"][a:b], ranks[rows], "right") - 1
            sequence = s["sequence"][entry] + ranks - s["first"][entry]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sequence), pa.array(s["offset"][entry])], names)

    return ranked.mapInArrow(place, schema).unionByName(odd)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenize documents, cut them into pieces and pack the pieces into few sequences.

    Returns one row per piece: id, piece, start, length, ids_crc32, sequence_id, offset
    and, if asked for, ids. Null ids stay null and repeated rows get places of their
    own; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    pieces = stored(tokenize_pieces(docs, id_col, text_col, path, capacity, end_id, with_ids), "pieces")
    return pack(pieces, capacity, (id_col, "piece", "ids_crc32"))


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each packed sequence, from ``pack_documents`` with its ids: sequence_id and ids.

    A sequence is at most ``capacity`` ids long, which bounds what a group gathers. Rows with a null
    sequence_id, offset or ids add nothing; equal offsets are joined by their ids' order; an
    empty table gives an empty result.
    """
    packed = packed.where("sequence_id is not null and offset is not null and ids is not null")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(parts.ids, X'', (a, x) -> concat(a, x))")
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"))
