"""Exact quantiles of many slices of a table at once, with no task that holds a column."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patterns import part_column

Part = tuple[str, str, object]
Slice = tuple[tuple[Part, ...], str]
_SIGN = np.int64(0x7FFFFFFFFFFFFFFF)


def _keys(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers; the two zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _SIGN, bits)


def _value(key: int) -> float:
    return float(np.array([key if key >= 0 else int(np.int64(key) ^ _SIGN)], np.int64).view(np.float64)[0])


def quantiles(rows: DataFrame, slices: Sequence[Slice], shares: Sequence[float] = (0.25, 0.5, 0.75), buckets: int = 4096, few: int = 1000) -> list[list[float]]:
    """For each slice, a conjunction of parts and a numeric column, its interpolated quantiles; none if it has no value.

    Nulls and NaN are no values. A first pass finds the range of each slice. Then each pass counts, in every range that
    still holds a wanted rank, at most ``buckets`` buckets of equal width in the order of doubles, or the values
    themselves once they are at most ``few``. So what reaches the driver is bounded, every aggregate is combined before
    its shuffle, and there are three passes for up to a few million rows and one more for each further factor of thousands.
    """
    if not slices:
        return []
    parts = list(dict.fromkeys(p for conjunction, _ in slices for p in conjunction))
    columns = list(dict.fromkeys(c for _, c in slices))
    tests = [F.coalesce(part_column(p), F.lit(False)).alias(f"_t{k}") for k, p in enumerate(parts)]
    source = rows.select(*tests, *[F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(columns)])
    plan = [([parts.index(p) for p in conjunction], len(parts) + columns.index(c)) for conjunction, c in slices]

    def each(batch: pa.RecordBatch, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        held = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        values = {k: (v := held[k].astype(np.float64), ~np.isnan(v)) for k in {k for _, k in plan}}
        for at, (conjunction, column) in enumerate(plan):
            if wanted is not None and at not in wanted:
                continue
            v, keep = values[column]
            for t in conjunction:
                keep = keep & held[t]
            if keep.any():
                yield at, _keys(v[keep])

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            for at, k in each(batch):
                n, low, high = found.get(at, (0, k[0], k[0]))
                found[at] = n + len(k), min(low, k.min()), max(high, k.max())
        made = [(at, *f) for at, f in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], pa.int64()) for c in range(4)], ["slice", "n", "low", "high"])

    first = source.mapInArrow(extent, "slice long, n long, low long, high long").groupBy("slice").agg(F.sum("n"), F.min("low"), F.max("high")).collect()
    sizes = {at: n for at, n, _, _ in first}
    want = {at: sorted({int(f((n - 1) * s)) for s in shares for f in (math.floor, math.ceil)}) for at, n in sizes.items()}
    found: dict[tuple[int, int], int] = {}
    # A range is (slice, lowest and highest key); it has how many values lie before and in it.
    open_ranges = {(at, low, high): (0, n) for at, n, low, high in first}
    while open_ranges:
        todo = {}
        for at, low, high in open_ranges:
            spread = int(high) - int(low)
            shift = 0 if open_ranges[at, low, high][1] <= few else max(0, spread.bit_length() - (buckets.bit_length() - 1))
            todo.setdefault(at, []).append((int(low), int(high), shift))
        for key, n in _counts(source, each, todo).items():
            open_ranges[key] = (open_ranges[key][0], n)
        following: dict[tuple[int, int, int], tuple[int, int]] = {}
        for (at, low, high), (before, counted) in open_ranges.items():
            shift = next(s for a, b, s in todo[at] if (a, b) == (low, high))
            for bucket, n in counted:
                inside = [r for r in want[at] if before <= r < before + n]
                if shift and inside:
                    start = low + (bucket << shift)
                    following[at, start, min(high, start + (1 << shift) - 1)] = (before, n)
                elif inside:
                    found.update({(at, r): bucket for r in inside})
                before += n
        open_ranges = following
    out = []
    for at in range(len(slices)):
        n, made = sizes.get(at, 0), []
        for s in shares if n else ():
            place = (n - 1) * s
            a, b = _value(found[at, math.floor(place)]), _value(found[at, math.ceil(place)])
            made.append(a if a == b else (math.ceil(place) - place) * a + (place - math.floor(place)) * b)
        out.append(made)
    return out


def _counts(source: DataFrame, each, todo: dict[int, list[tuple[int, int, int]]]) -> dict[tuple[int, int, int], list[tuple[int, int]]]:
    """For each range, (bucket, count) in order; a bucket of a range without shift is the key itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], dict[int, int]] = {}
        for batch in batches:
            for at, k in each(batch, set(todo)):
                for number, (low, high, shift) in enumerate(todo[at]):
                    here = k[(k >= low) & (k <= high)]
                    if shift:  # differences of up to 64 bits
                        here = ((here.view(np.uint64) - np.uint64(low % 2**64)) >> np.uint64(shift)).astype(np.int64)
                    held = sums.setdefault((at, number), {})
                    for bucket, n in zip(*(x.tolist() for x in np.unique(here, return_counts=True)), strict=True):
                        held[bucket] = held.get(bucket, 0) + n
        rows = [(at, number, bucket, n) for (at, number), held in sums.items() for bucket, n in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["slice", "number", "bucket", "n"])

    made = source.mapInArrow(run, "slice long, number long, bucket long, n long").groupBy("slice", "number", "bucket").agg(F.sum("n").alias("n")).collect()
    out: dict[tuple[int, int, int], list[tuple[int, int]]] = {(at, low, high): [] for at, ranges in todo.items() for low, high, _ in ranges}
    for at, number, bucket, n in sorted(made):
        low, high, _ = todo[at][number]
        out[at, low, high].append((bucket, n))
    return out
