"""Embedding near-duplicates over an inverted multi-index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches, stored
from .components import connected_components


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 6) -> np.ndarray:
    """Centroids of the rows, spread at first by their distances; fewer than ``k`` if rows are few."""
    rng = np.random.default_rng(seed)
    centroids = [x[rng.integers(len(x))]]
    far = _squared(x, centroids[0][None])[:, 0]
    while len(centroids) < min(k, len(x)) and far.sum() > 0:
        centroids.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, _squared(x, centroids[-1][None])[:, 0])
    out = np.array(centroids)
    for _ in range(rounds):
        near = _squared(x, out).argmin(1)
        for c in np.unique(near):
            out[c] = x[near == c].mean(0)
    return out


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances. Sums are made row by row, so that a row has the same in whatever batch it comes."""
    out, step = np.empty((len(x), len(c))), max(1, 2**21 // c.size)
    for at in range(0, len(x), step):
        out[at : at + step] = ((x[at : at + step, None, :] - c[None]) ** 2).sum(2)
    return out


def multi_sequence(first: np.ndarray, second: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row, cells i * width + j by increasing first[i] + second[j], as far as ``bound`` beyond the nearest.

    Both distances are sorted. Of each i, the nearest j not yet visited is a candidate; all rows step to their nearest
    candidate at once. Returns (row, cell) of all visits.
    """
    a, b = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
    near, beside = np.take_along_axis(first, a, 1), np.take_along_axis(second, b, 1)
    limit, wide = near[:, 0] + beside[:, 0] + bound, second.shape[1]
    at, cost, rows, out = np.zeros(first.shape, np.int64), near + beside[:, :1], np.arange(len(first)), []
    while len(rows):
        i = cost[rows].argmin(1)
        go = cost[rows, i] <= limit[rows]
        rows, i = rows[go], i[go]
        out.append((rows, a[rows, i] * wide + b[rows, at[rows, i]]))
        at[rows, i] += 1
        j = at[rows, i]
        cost[rows, i] = np.where(j < wide, near[rows, i] + beside[rows, np.minimum(j, wide - 1)], np.inf)
    return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])


class MultiIndex:
    """Two codebooks, one for each half of a unit vector, and how far a traversal has to go.

    A codebook has at most a centroid for 16 vectors of the sample.
    """

    def __init__(self, sample: np.ndarray, cells: int, cosine: float, recall: float, seed: int = 6):
        self.half = (sample.shape[1] + 1) // 2
        k = max(1, min(round(cells**0.5), len(sample) // 16))
        second = sample[:, self.half :] if sample.shape[1] > self.half else np.zeros((len(sample), 1))
        self.books = kmeans(sample[:, : self.half], k), kmeans(second, k)
        rng = np.random.default_rng(seed)
        turned = rng.normal(size=sample.shape)
        turned -= (turned * sample).sum(1, keepdims=True) * sample
        norm = np.linalg.norm(turned, axis=1, keepdims=True)
        other = np.where(norm > 1e-9, cosine * sample + (1 - cosine * cosine) ** 0.5 * turned / np.maximum(norm, 1e-9), sample)
        costs = [self._cost(sample, other)]
        for at in range(0, len(sample), 512):  # and the pairs of the sample that are linked
            i, j = np.nonzero(sample[at : at + 512] @ sample.T >= cosine)
            keep = np.flatnonzero(i + at < j)[:4096]
            if len(keep):
                costs.append(self._cost(sample[i[keep] + at], sample[j[keep]]))
        self.bound = max(float(np.quantile(c, recall)) for c in costs) + 1e-9

    def _cost(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far beyond its nearest cell a traversal from x must go to meet y, or one from y to meet x, if that is less."""
        (x1, x2), (y1, y2) = self.distances(x), self.distances(y)
        rows = np.arange(len(x))
        from_x = x1[rows, y1.argmin(1)] + x2[rows, y2.argmin(1)] - x1.min(1) - x2.min(1)
        from_y = y1[rows, x1.argmin(1)] + y2[rows, x2.argmin(1)] - y1.min(1) - y2.min(1)
        return np.minimum(from_x, from_y)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        second = x[:, self.half :] if x.shape[1] > self.half else np.zeros((len(x), 1))
        return _squared(x[:, : self.half], self.books[0]), _squared(second, self.books[1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each vector, and (row, cell) of all visits of the searches from them, their own cells among them."""
        first, second = self.distances(x)
        return first.argmin(1) * len(self.books[1]) + second.argmin(1), *multi_sequence(first, second, self.bound)

    def visits(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether the search from each vector visits each of ``cells``, as ``cells`` finds it."""
        first, second = self.distances(x)
        i, j = np.divmod(cells, len(self.books[1]))
        return first[:, i] + second[:, j] <= (first.min(1) + second.min(1) + self.bound)[:, None]


def _raw(column: pa.Array) -> np.ndarray:
    """The bytes of a column of binaries of one length, a row for each."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _unit(raw: np.ndarray, kind: str) -> np.ndarray:
    x = np.ascontiguousarray(raw).view(kind).astype(np.float64)
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` the smallest that links (u, v) join it with."""
    label = np.arange(n)
    while True:
        now = label.copy()
        np.minimum.at(now, u, label[v])
        np.minimum.at(now, v, label[u])
        now = now[now]
        if (now == label).all():
            return label
        label = now


_SEARCH = "target int, search_part int, member_part int, side int, node binary, vector binary, many long, cell int"


def _compare(cosine: float, kind: str, index) -> Callable:
    """Rows (a, b, links): links of node a if b is null, else a link that joins a and b."""

    def task(target: int, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        """Searches that visit a cell against vectors in it."""
        side = rows.column(3).to_numpy()
        cut = int(np.searchsorted(side, 1))
        if cut in (0, len(side)):
            return None
        x, many, cell = _unit(_raw(rows.column(5)), kind), rows.column(6).to_numpy(), rows.column(7).to_numpy()
        names = np.ascontiguousarray(_raw(rows.column(4))).view(">u8").astype(np.uint64)
        similar = x[:cut] @ x[cut:].T >= cosine
        inside = np.flatnonzero(cell[:cut] == target)
        if len(inside):  # both search this cell: the pair counts once
            a, b = names[inside][:, None], names[cut:][None]
            similar[inside] &= (a[..., 0] < b[..., 0]) | ((a[..., 0] == b[..., 0]) & (a[..., 1] < b[..., 1]))
        below = np.flatnonzero((cell[:cut] < target) & similar.any(1))
        if len(below):  # where a search from the other side meets this one in a lower cell, the pair counts there
            at, cells = np.flatnonzero(similar[below].any(0)), np.unique(cell[below])
            met = index.value.visits(x[cut:][at], cells)
            similar[np.ix_(below, at)] &= ~met[:, np.searchsorted(cells, cell[below])].T
        i, j = np.nonzero(similar)
        if not len(i):
            return None
        found = np.concatenate([np.bincount(i, many[cut:][j], cut), np.bincount(j, many[:cut][i], len(side) - cut)]).astype(np.int64)
        _, first, node = np.unique(names, axis=0, return_index=True, return_inverse=True)
        node = node.reshape(-1)
        root = _joined(len(first), node[i], node[cut + j])
        counted, apart = np.flatnonzero(found), np.flatnonzero(root != np.arange(len(root)))
        ids = rows.column(4)
        a = pa.concat_arrays([ids.take(pa.array(counted)), ids.take(pa.array(first[apart]))])
        b = pa.concat_arrays([pa.nulls(len(counted), pa.binary()), ids.take(pa.array(first[root[apart]]))])
        return pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([found[counted], np.zeros(len(apart), np.int64)]))], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in chain(batches, [None]):
            keys = None if batch is None else np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            starts = [0] if batch is None else [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in pairwise(starts) if batch is not None else [(0, 0)]:
                now = None if batch is None else tuple(keys[a])
                if now != key and held:
                    found = task(int(key[0]), pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    if found is not None:
                        yield found
                    held = []
                key = now
                if batch is not None:
                    held.append(batch.slice(a, b - a))

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = 0.9,
    recall: float = 0.99,
    per_cell: int = 256,
    chunk: int = 1024,
    most_sample: int = 4096,
) -> DataFrame:
    """Links between vectors whose cosine, in double precision, is at least ``cosine``.

    Codebooks for the two halves of the unit vectors are fitted on a bounded sample of at most
    ``most_sample`` distinct vectors; they make a product grid of about one cell for ``per_cell``
    vectors, as far as the sample allows, and every vector is put into its cell. Every vector is also a query: a
    multi-sequence traversal visits cells by increasing distance, as far beyond the nearest
    as found enough for ``recall`` on sample pairs just at the limit. The searches that visit
    a cell are compared with its vectors exactly, in blocks of ``chunk`` from either side: large
    cells are shared among tasks, which emit only counts and links that join what was apart.
    A pair counts if a search from either of its vectors meets the other.

    Returns one row per input row: id, n_links (other rows linked directly), component_id (smallest
    id reachable), kept. Equal vectors are one node and linked with each other. Vectors that
    are null, zero, hold null or non-finite components, or differ in length from most, link
    with nothing: n_links 0 and their own component. A null id counts as a row but names
    no component. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    source = pick(vectors, id_col, vector_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = "<f4" if dict(source.dtypes)["v"] == "array<float>" else "<f8"
    source = source if kind == "<f4" else source.withColumn("v", F.col("v").cast("array<double>"))
    sizes = source.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    width = sizes[0]["d"] if sizes else 0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets)
            values = lists.values.to_numpy(zero_copy_only=False).astype(kind)  # null components become NaN
            there = ~np.asarray(lists.is_null()) & (np.diff(ends) == width) if width else np.zeros(len(lists), bool)
            at = np.flatnonzero(there)
            x = values[ends[at][:, None] + np.arange(width)] + np.array(0, kind)  # the two zeros are one
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            raw: list[bytes | None] = [None] * len(lists)
            for k, v in zip(at[good].tolist(), x[good], strict=True):
                raw[k] = v.tobytes()
            nodes = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(raw, pa.binary())], ["id", "node", "vector"])

    rows = stored(source.mapInArrow(keyed, "id long, node binary, vector binary"), "vectors")
    nodes = stored(rows.where("node is not null").groupBy("node").agg(F.min("vector").alias("vector"), F.count("*").alias("many"), F.min("id").alias("low")), "vector-nodes")
    total = nodes.count()
    spread = 2**20
    picked = nodes.where(F.pmod(F.xxhash64("node"), F.lit(spread)) < int(spread * min(1.0, 0.9 * most_sample / max(total, 1))) + (total <= most_sample))
    sample = sorted((bytes(r[0]), bytes(r[1])) for r in picked.limit(most_sample).select("node", "vector").collect())
    if not sample:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    unit = _unit(np.frombuffer(b"".join(v for _, v in sample), np.uint8).reshape(len(sample), -1), kind)
    index = spark.sparkContext.broadcast(MultiIndex(unit, max(1, total // per_cell), cosine, recall))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, row, cell = index.value.cells(_unit(_raw(batch.column(1)), kind))
                order = np.argsort(row, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(own)))]).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), visits], ["node", "vector", "many", "cell", "visits"])

    placed = nodes.select("node", "vector", "many").mapInArrow(assign, "node binary, vector binary, many long, cell int, visits array<int>")
    placed = stored(placed, "placed")
    searches = placed.select("node", "vector", "many", "cell", F.explode("visits").alias("target"))
    parts = lambda name: F.ceil(F.count("*") / chunk).cast("int").alias(name)
    sizes = searches.groupBy("target").agg(parts("searches")).join(placed.groupBy(F.col("cell").alias("target")).agg(parts("members")), "target")
    sizes = stored(sizes, "cell-sizes")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = [x.split()[0] for x in _SEARCH.split(", ")]
    left = searches.join(sizes, "target").withColumn("search_part", part("searches")).withColumn("member_part", every("members"))
    right = placed.drop("visits").withColumn("target", F.col("cell")).join(sizes, "target").withColumn("member_part", part("members")).withColumn("search_part", every("searches"))
    tasks = left.withColumn("side", F.lit(0)).select(names).unionByName(right.withColumn("side", F.lit(1)).select(names))
    tasks = tasks.repartition(*names[:3]).sortWithinPartitions(*names[:4])
    found = stored(tasks.mapInArrow(_compare(cosine, kind, index), "a binary, b binary, links long"), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "node")
    known = nodes.select("node", "many", "low").join(counts, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = stored(known, "known")
    lowest = stored(known.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    known = known.join(lowest, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
