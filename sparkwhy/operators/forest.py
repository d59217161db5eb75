"""Importances of a random forest, for samples that fit on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


def _binned(x: np.ndarray, bins: int) -> np.ndarray:
    """Each column by the quantile bin that its values fall in; columns of few values keep them apart."""
    out = np.empty(x.shape, np.int64)
    for j, column in enumerate(x.T):
        values = np.unique(column)
        edges = (values[1:] + values[:-1]) / 2 if len(values) <= bins else np.unique(np.quantile(column, np.arange(1, bins) / bins))
        out[:, j] = np.searchsorted(edges, column, "left")
    return out


def importances(x: np.ndarray, label: np.ndarray, trees: int = 500, depth: int = 10, bins: int = 32, seed: int = 1, at_once: int = 25, spark: SparkSession | None = None) -> np.ndarray:
    """Mean decrease of Gini impurity by each column over bootstrapped trees, each tree's summing to 1.

    Of a square root of the columns, drawn anew for each node, the best split is taken. All nodes of a level of
    ``at_once`` trees are split together: their class counts by bin are one count of integers for each column, so the
    time is that of counting, not of Python. With a session, such groups of trees are grown by tasks of its cluster, to
    which the sample is broadcast; the result is the same. Without columns, rows or two labels, all are 0.
    """
    if not x.size or label.min() == label.max():
        return np.zeros(x.shape[1])
    groups = [(k, min(at_once, trees - at)) for k, at in enumerate(range(0, trees, at_once))]
    binned = _binned(x, bins)
    if spark is None:
        sums = [_grown(binned, label, some, depth, bins, (seed, k)) for k, some in groups]
    else:
        shared = spark.sparkContext.broadcast((binned.astype(np.uint8 if bins <= 256 else np.int64), label.astype(np.uint8)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, marks = shared.value
            for batch in batches:
                made = [_grown(held.astype(np.int64), marks.astype(float), some, depth, bins, (seed, k)) for k, some in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["k", "sums"])

        tasks = min(len(groups), spark.sparkContext.defaultParallelism)
        rows = spark.createDataFrame(groups, "k int, some int").repartition(tasks).mapInArrow(run, "k int, sums array<double>").collect()
        sums = [np.array(r["sums"]) for r in sorted(rows, key=lambda r: r["k"])]
        shared.destroy()
    total = np.sum(sums, 0)
    return total / total.sum() if total.sum() > 0 else total


def _grown(binned: np.ndarray, label: np.ndarray, some: int, depth: int, bins: int, seed: tuple[int, int]) -> np.ndarray:
    """Importances summed over ``some`` trees."""
    n, p = binned.shape
    rng, drawn = np.random.default_rng(seed), max(1, round(p**0.5))
    weight = rng.poisson(1.0, (some, n))
    tree, row = np.nonzero(weight)
    w = weight[tree, row].astype(float)
    wy = w * label[row]
    node, tree_of, gains = tree, np.arange(some), np.zeros((some, p))
    for _ in range(depth):
        k = len(tree_of)
        allowed = rng.random((k, p)).argsort(1).argsort(1) < drawn
        best, column, cut = np.full(k, 1e-9), np.full(k, -1), np.zeros(k, np.int64)
        for j in range(p):
            nodes = np.flatnonzero(allowed[:, j])
            place = np.full(k, -1)
            place[nodes] = np.arange(len(nodes))
            here = place[node] >= 0
            at = place[node[here]] * bins + binned[row[here], j]
            left = np.bincount(at, w[here], len(nodes) * bins).reshape(-1, bins).cumsum(1)
            left_y = np.bincount(at, wy[here], len(nodes) * bins).reshape(-1, bins).cumsum(1)
            whole, whole_y = left[:, -1:], left_y[:, -1:]
            right, right_y = whole - left, whole_y - left_y
            # The impurity of a side is twice y - y * y / n; only the second term depends on the split.
            gain = left_y**2 / np.maximum(left, 1) + right_y**2 / np.maximum(right, 1)
            gain[(left == 0) | (right == 0)] = 0
            b = gain.argmax(1)
            g = 2 * (gain[np.arange(len(nodes)), b] - (whole_y**2 / np.maximum(whole, 1))[:, 0])
            better = g > best[nodes]
            to = nodes[better]
            best[to], column[to], cut[to] = g[better], j, b[better]
        split = np.flatnonzero(column >= 0)
        if not len(split):
            break
        np.add.at(gains, (tree_of[split], column[split]), best[split])
        number = np.full(k, -1)
        number[split] = np.arange(len(split))
        stay = column[node] >= 0
        node, row, w, wy = node[stay], row[stay], w[stay], wy[stay]
        node = 2 * number[node] + (binned[row, column[node]] > cut[node])
        tree_of = np.repeat(tree_of[split], 2)
    sums = gains.sum(1, keepdims=True)
    return (gains / np.where(sums > 0, sums, 1)).sum(0)
