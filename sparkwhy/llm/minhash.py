"""MinHash near-duplicates with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, pick, row_hash, small_batches, stored, without
from .components import connected_components, linked
from .shingles import MinHasher, WordHashes, shingle_set

BATCH = 16
DEFAULTS = {"width": 5, "percent": 80, "bands": 24, "rows": 4, "miss": 1e-7, "block_members": 512, "block_shingles": 400_000}


def least_matches(hashes: int, similarity: float, miss: float, step: int = BATCH) -> list[int]:
    """Matches needed after each batch of ``step`` one-byte hashes to stay a candidate.

    With a uniform prior, the posterior of the Jaccard similarity s after m matches of n is
    in proportion to p^m (1-p)^(n-m), p = s + (1-s)/256. Fewer matches than the number
    returned leave the event s >= ``similarity`` a probability below ``miss``.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    needed = []
    for n in range(step, hashes + 1, step):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[s >= similarity].sum() >= miss * weight.sum():
                needed.append(m)
                break
    return needed


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, hasher = WordHashes(), MinHasher(bands * rows)
        for batch in batches:
            ids, text_hash, texts = (c for c in batch.columns)
            sets = [shingle_set(t, width, cache) for t in texts.to_pylist()]
            signature = hasher(sets)
            band = np.ascontiguousarray(signature).reshape(len(sets), bands, rows).view(np.uint8).reshape(len(sets), bands, rows * 4)
            keys = [[_band_key(k, band[i, k].tobytes()) for k in range(bands)] if len(s) else [] for i, s in enumerate(sets)]
            made = [
                ids, text_hash, pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([len(s).to_bytes(8, "little") + x.tobytes() for s, x in zip(sets, signature.astype(np.uint8), strict=True)], pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(made, ["id", "text_hash", "node", "n_shingles", "signature", "bands"])

    return run


def _band_key(band: int, values: bytes) -> int:
    return xxhash.xxh3_64_intdigest(values, band) - 2**63


def _similar_signatures(needed: list[int], percent: int, step: int = BATCH):
    """Compare members by batches of their signatures; payload: 8 bytes of set size, then hashes."""

    def compare(left: list[tuple], right: list[tuple] | None) -> Iterator[tuple]:
        rows = left + (right or [])
        raw = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        size = raw[:, :8].copy().view(np.int64)[:, 0]
        hashes = raw[:, 8:]
        group = _start(rows)
        for i in range(len(left) if right else len(rows) - 1):
            at = np.arange(len(left) if right else i + 1, len(rows))
            at = at[(group[at] != group[i]) & (100 * np.minimum(size[at], size[i]) >= percent * np.maximum(size[at], size[i]))]
            match = np.zeros(len(at), np.int64)
            for k, least in enumerate(needed):
                if not len(at):
                    break
                part = slice(k * step, (k + 1) * step)
                match = match + (hashes[at, part] == hashes[i, part]).sum(1)
                stay = match >= least
                at, match = at[stay], match[stay]
            for j in at.tolist():
                if group[i] != group[j]:
                    group[group == group[j]] = group[i]
                    yield rows[i][0], rows[j][0]

    return compare


def _start(rows: list[tuple]) -> np.ndarray:
    """A number for each row, equal where labels tell that links join them."""
    seen: dict = {}
    return np.array([seen.setdefault(r[0] if r[3] is None else r[3], len(seen)) for r in rows])


def _similar_sets(percent: int):
    """Compare members by their whole shingle sets; payload: sorted distinct 64-bit hashes."""

    def compare(left: list[tuple], right: list[tuple] | None) -> Iterator[tuple]:
        rows = left + (right or [])
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        size = np.array([len(s) for s in sets])
        group = _start(rows)
        if len(rows) == 2:
            shared = len(np.intersect1d(*sets, assume_unique=True))
            if group[0] != group[1] and 100 * shared >= percent * (size[0] + size[1] - shared):
                yield rows[0][0], rows[1][0]
            return
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        starts = ends - size
        mark = np.zeros(int(number.max()) + 1, np.int32)
        for i in range(len(left) if right else len(rows) - 1):
            first = len(left) if right else i + 1
            at = np.arange(first, len(rows))
            fit = (group[at] != group[i]) & (100 * np.minimum(size[at], size[i]) >= percent * np.maximum(size[at], size[i]))
            if not fit.any():
                continue
            mark[number[starts[i] : ends[i]]] = 1
            if fit.mean() > 0.5:
                shared = np.add.reduceat(mark[number[starts[first] :]], starts[first:] - starts[first])[fit]
            else:
                shared = np.array([mark[number[starts[j] : ends[j]]].sum() for j in at[fit]])
            mark[number[starts[i] : ends[i]]] = 0
            at = at[fit]
            for j in at[100 * shared >= percent * (size[at] + size[i] - shared)].tolist():
                if group[i] != group[j]:
                    group[group == group[j]] = group[i]
                    yield rows[i][0], rows[j][0]

    return compare


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = DEFAULTS["width"],
    percent: int = DEFAULTS["percent"],
    bands: int = DEFAULTS["bands"],
    rows: int = DEFAULTS["rows"],
    miss: float = DEFAULTS["miss"],
    block_members: int = DEFAULTS["block_members"],
    block_shingles: int = DEFAULTS["block_shingles"],
) -> DataFrame:
    """Groups of documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100.

    Documents with equal sets are one node. Nodes that share a band of MinHash values are
    candidates; batches of their signatures are compared and a pair is dropped once the
    posterior probability of a sufficient similarity is below ``miss``. What survives makes
    clusters, inside which the whole sets are compared exactly, block by block. With
    24 bands of 4 rows, a pair at a similarity of 0.85 shares no band with probability
    2e-8, at 0.8 with 5e-6; everything after that is exact but for ``miss``.

    Returns one row per input row: id, n_shingles, component_id (the smallest id of its
    group) and kept (id = component_id). Null texts and texts without words have
    n_shingles 0 and are their own component, as are rows with a null id and no group.
    A null id in a group gets the group's smallest id and is not kept. Repeated rows
    are equal rows of one group. An empty table gives an empty result.
    """
    signed, named = _grouped(docs, id_col, text_col, width, percent, bands, rows, miss, block_members, block_shingles)
    out = signed.select("id", "node", "n_shingles").join(named.select("node", "component_id"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row, with all its columns, of each group that ``near_duplicates`` finds, and all rows without words.

    It is the row with the smallest id, nulls last, and of rows that share this id the text with the smallest
    hash. If the row is there more than once, one of its copies stays, whatever their other columns hold.
    """
    names = ("width", "percent", "bands", "rows", "miss", "block_members", "block_shingles")
    signed, named = _grouped(docs, id_col, text_col, *[options.get(n, DEFAULTS[n]) for n in names])
    first = signed.where("node is not null").select("id", "node", "text_hash").join(named, "node")
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    gone = first.where(~stays).select("id", F.col("text_hash").alias("row_hash"))
    often = stored(first.where(stays).groupBy("id", "text_hash").agg(F.count("*").alias("n")).where("n > 1"), "repeated").select("id", F.col("text_hash").alias("row_hash"))
    once = without(docs, gone.unionByName(often), id_col, (text_col,))
    if often.isEmpty():
        return once
    match = docs[id_col].cast("long").eqNullSafe(often["id"]) & (row_hash(text_col) == often["row_hash"])
    many = docs.join(often, match, "left_semi")
    return once.unionByName(many.dropDuplicates([id_col, text_col]))


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int, miss: float, block_members: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows (id, text_hash, node, n_shingles, ...), and of each node its component_id and the row that stands for its group."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), row_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = "id long, text_hash long, node binary, n_shingles long, signature binary, bands array<long>"
    signed = stored(texts.mapInArrow(_signatures(width, bands, rows), schema), "signatures")
    first = F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("first")
    nodes = stored(
        signed.where("node is not null").groupBy("node")
        .agg(first, F.min("n_shingles").alias("n"), F.min("signature").alias("signature"), F.first("bands").alias("bands"))
        .select("node", F.col("first.id").alias("id"), "first.text_hash", "n", "signature", "bands"),
        "nodes",
    )
    buckets = nodes.select(F.explode("bands").alias("group"), F.col("node").alias("id"), F.lit(1).alias("weight"), F.col("n").alias("size"))
    payload = nodes.select(F.col("node").alias("id"), F.col("signature").alias("payload"))
    needed = least_matches(bands * rows, percent / 100, miss)
    likely = linked(buckets, payload, _similar_signatures(needed, percent), block_members, block_members, percent / 100)
    clusters = stored(connected_components(likely), "clusters")
    wanted = clusters.join(nodes.select("node", "id", "text_hash", "n").withColumnRenamed("id", "doc"), clusters["id"] == F.col("node"))
    wanted = stored(wanted.select(F.col("component").alias("group"), "node", "doc", "text_hash", "n"), "candidates")
    keys = bounded_broadcast(wanted.select("doc", F.col("text_hash").alias("hash")), 200_000)
    chosen = texts.join(keys, texts["id"].eqNullSafe(F.col("doc")) & (texts["text_hash"] == F.col("hash")), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            found = [shingle_set(t, width, cache).tobytes() for t in batch.column(0).to_pylist()]
            nodes_of = [xxhash.xxh3_128_digest(s) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(nodes_of, pa.binary()), pa.array(found, pa.binary())], ["id", "payload"])

    exact = linked(
        wanted.select("group", F.col("node").alias("id"), F.col("n").alias("weight"), F.col("n").alias("size")),
        chosen.select("text").mapInArrow(sets, "id binary, payload binary"), _similar_sets(percent), block_shingles, block_members, percent / 100,
    )
    parts = connected_components(exact).withColumnRenamed("id", "node")
    lowest_row = F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("low")
    smallest = signed.where("node is not null").groupBy("node").agg(lowest_row).join(parts, "node", "left")
    smallest = stored(smallest.withColumn("component", F.coalesce("component", "node")), "smallest")
    lowest = stored(smallest.groupBy("component").agg(F.min("low").alias("low")).select("component", F.col("low.id").alias("first_id"), F.col("low.text_hash").alias("first_hash")), "lowest")
    named = smallest.select("component", "node").join(lowest, "component")
    return signed, stored(named.select("node", F.col("first_id").alias("component_id"), "first_id", "first_hash"), "named")
