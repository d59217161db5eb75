"""Recall, precision and F-score of many patterns in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patterns import Pattern, part_column

SIDES = ("yes", "no")
_BITS, _MASKS = 62, 32


def side_sizes(rows: DataFrame) -> dict[str, int]:
    """Distinct tuples of each side, as ``pnumber`` names them."""
    found = rows.groupBy("is_user").agg(F.count_distinct("pnumber").alias("n")).collect()
    return {s: 0 for s in SIDES} | {r["is_user"]: r["n"] for r in found}


def sizes_and_rows(rows: DataFrame) -> tuple[dict[str, int], int]:
    """Distinct tuples of each side, and rows of the table."""
    found = rows.groupBy("is_user").agg(F.count_distinct("pnumber").alias("n"), F.count("*").alias("rows")).collect()
    return {s: 0 for s in SIDES} | {r["is_user"]: r["n"] for r in found}, sum(r["rows"] for r in found)


def matching_tuples(rows: DataFrame, patterns: Sequence[Pattern], single: bool = False) -> list[dict[str, int]]:
    """For each pattern, the distinct tuples of each side that have a row where it holds.

    The parts of all patterns are few, as patterns share them. An equality is one boolean column; bounds are
    compared in Python, to which their numeric columns go. There whole batches are combined into one
    bit for each pattern in a few long integers. As joins repeat tuples, rows are then reduced to one per tuple by
    bitwise or: the shuffle carries a row per tuple, combined before it is sent, however
    many patterns there are. Their bits are counted per partition, and the counts summed. Where no join
    repeats a tuple (``single``), matches are counted where the rows are, and nothing is shuffled but counts.
    """
    out: list[dict[str, int]] = []
    for start in range(0, len(patterns), _BITS * _MASKS):
        out += _counted(rows, patterns[start : start + _BITS * _MASKS], single)
    return out


def _counted(rows: DataFrame, patterns: Sequence[Pattern], single: bool) -> list[dict[str, int]]:
    tests: dict[tuple, int] = {}
    numbers: dict[str, int] = {}
    for p in patterns:
        for part in p.parts():
            if part[1] == "=":
                tests.setdefault(part, len(tests))
            else:
                numbers.setdefault(part[0], len(numbers))
    kinds: dict[tuple, int] = {}
    uses = [[kinds.setdefault(part, len(kinds)) for part in p.parts()] for p in patterns]
    # (position among the columns, comparison, constant) of each part
    parts = [(tests[t], None, None) if t[1] == "=" else (len(tests) + numbers[t[0]], t[1], float(t[2])) for t in kinds]
    columns = [F.coalesce(part_column(t), F.lit(False)).alias(f"_t{k}") for t, k in tests.items()]
    columns += [F.col(c).cast("double").alias(f"_v{k}") for c, k in numbers.items()]
    masks = [f"_m{k}" for k in range(-(-len(patterns) // _BITS))]
    schema = f"is_user string, pnumber long, {', '.join(f'{m} long' for m in masks)}"

    def matches(batch: pa.RecordBatch, first: int) -> Iterator[tuple[int, np.ndarray]]:
        held = [c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]]
        above = {}  # NaN is above every number, null above none
        for k, op, _ in parts:
            if op == ">" and k not in above:
                nan = np.isnan(held[k])
                above[k] = nan & ~batch.column(first + k).is_null().to_numpy(zero_copy_only=False) if nan.any() else None
        made = []
        for k, op, c in parts:
            made.append(held[k] if op is None else held[k] < c if op == "<" else held[k] > c if above[k] is None else (held[k] > c) | above[k])
        for k, use in enumerate(uses):
            match = np.ones(batch.num_rows, bool)
            for t in use:
                match &= made[t]
            yield k, match

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, len(patterns)), np.int64)
        for batch in batches:
            yes = batch.column(0).to_numpy(zero_copy_only=False) == "yes"
            for k, match in matches(batch, 1):
                n = int((match & yes).sum())
                found[:, k] += n, int(match.sum()) - n
        side, at = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([SIDES[s] for s in side], pa.string()), pa.array(at.astype(np.int32)), pa.array(found[side, at])], ["is_user", "pattern", "n"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.zeros(batch.num_rows, np.int64) for _ in masks]
            for k, match in matches(batch, 2):
                made[k // _BITS] |= match.astype(np.int64) << (k % _BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, made)], ["is_user", "pnumber", *masks])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {s: np.zeros(len(patterns), np.int64) for s in SIDES}
        for batch in batches:
            side = batch.column(0).to_numpy(zero_copy_only=False)
            for s in SIDES:
                for k in range(len(patterns)):
                    found[s][k] += ((batch.column(1 + k // _BITS).to_numpy()[side == s] >> (k % _BITS)) & 1).sum()
        for s, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["is_user", "pattern", "n"])

    result = "is_user string, pattern int, n long"
    if single:
        counts = rows.where(F.col("is_user").isin(*SIDES)).select("is_user", *columns).mapInArrow(direct, result)
    else:
        bits = rows.select("is_user", F.col("pnumber").cast("long").alias("pnumber"), *columns).mapInArrow(combine, schema)
        tuples = bits.groupBy("is_user", "pnumber").agg(*[F.bit_or(m).alias(m) for m in masks]).drop("pnumber")
        counts = tuples.mapInArrow(count, result)
    totals = counts.groupBy("is_user", "pattern").agg(F.sum("n").alias("n")).collect()
    found = {(r["is_user"], r["pattern"]): r["n"] for r in totals}
    return [{s: found.get((s, k), 0) for s in SIDES} for k in range(len(patterns))]


def round5(x: float) -> float:
    return floor(x * 100000 + 0.5) / 100000


def measures(tp: int, found: int, side: int) -> tuple[float, float, float]:
    """(recall rounded to five digits, precision, F-score): the score uses the rounded recall."""
    recall = round5(tp / side) if side else 0.0
    precision = tp / found if found else 0.0
    f1 = 2 * round5(precision * recall / (precision + recall)) if precision + recall else 0.0
    return recall, precision, f1


def score(rows: DataFrame, patterns: Sequence[Pattern], sizes: dict[str, int], mode: str = "o", sample: DataFrame | None = None, sample_sizes: dict[str, int] | None = None, single: bool = False) -> list[Pattern]:
    """Patterns with their measures on the whole table (``o``), a sample (``s``) or both (``e``).

    Without a sample, the whole table is used. In mode ``e`` the measures are
    those of the whole table, and those of the sample stand beside them. ``single``: no tuple has two rows.
    """
    if sample is None:
        mode = "o"
    different = {(p.nominal, p.ordinal): p for p in patterns}

    def on(table: DataFrame, side: dict[str, int]) -> list[tuple[float, float, float]]:
        found = dict(zip(different, matching_tuples(table, list(different.values()), single), strict=True))
        return [measures(n[p.is_user], n["yes"] + n["no"], side[p.is_user]) for p in patterns for n in [found[p.nominal, p.ordinal]]]

    whole = on(rows, sizes) if mode in "oe" else None
    part = on(sample, sample_sizes or side_sizes(sample)) if mode in "se" else None
    out = []
    for k, p in enumerate(patterns):
        r, q, f = (whole or part)[k]
        p = replace(p, recall=r, precision=q, f1=f)
        if part:
            p = replace(p, sample_recall=part[k][0], sample_precision=part[k][1], sample_f1=part[k][2])
        out.append(p)
    return out


def score_fractional(rows: DataFrame, patterns: Sequence[Pattern]) -> list[tuple[float, float, float]]:
    """Measures in which each row of a joined table counts as one over the rows of its tuple."""
    sizes = rows.groupBy("is_user", "pnumber").agg(F.count("*").alias("_n"))
    shared = rows.join(sizes, ["is_user", "pnumber"]).withColumn("_w", F.round(1 / F.col("_n"), 5))
    sums = [F.sum(F.when(p.predicate(), F.col("_w")).otherwise(0.0)).alias(f"_s{k}") for k, p in enumerate(patterns)]
    found = {r["is_user"]: r for r in shared.groupBy("is_user").agg(F.sum("_w").alias("_all"), *sums).collect()}
    out = []
    for k, p in enumerate(patterns):
        got = {s: (found[s][f"_s{k}"] or 0.0) if s in found else 0.0 for s in SIDES}
        total = found[p.is_user]["_all"] if p.is_user in found else 0.0
        recall = round5(got[p.is_user] / total) if total else 0.0
        precision = got[p.is_user] / sum(got.values()) if sum(got.values()) else 0.0
        out.append((recall, precision, 2 * round5(precision * recall / (precision + recall)) if precision + recall else 0.0))
    return out


def sampling_error(patterns: Sequence[Pattern], threshold: float = 0.0) -> dict[str, float]:
    """Squared error of sampled scores, and patterns that the threshold would treat differently."""
    both = [p for p in patterns if p.sample_f1 is not None]
    return {
        "evaluated": len(both), "error_sum_of_squares": sum((p.f1 - p.sample_f1) ** 2 for p in both),
        "misclassified": sum((p.recall > threshold) != (p.sample_recall > threshold) for p in both),
    }
