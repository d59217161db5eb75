"""Which numeric attributes to use: correlated ones are clustered, representatives ranked by a forest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .forest import importances


def value_entropy(values: np.ndarray) -> float:
    """Natural-log entropy of how often each value occurs."""
    _, counts = np.unique(values, return_counts=True)
    p = counts / counts.sum()
    return float(-(p * np.log(p)).sum())


def varying(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one value, nulls aside, in one pass."""
    if not columns:
        return []
    found = rows.agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if found[c]]


def _eigen(corr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(values)[::-1]
    return values[order], vectors[:, order]


def _quartimax(a: np.ndarray) -> np.ndarray:
    """Two columns of loadings, turned so that squares of squares are largest."""
    u, v = a[:, 0] ** 2 - a[:, 1] ** 2, 2 * a[:, 0] * a[:, 1]
    angle = np.arctan2(2 * (u * v).sum(), (u * u - v * v).sum()) / 4
    c, s = np.cos(angle), np.sin(angle)
    return a @ np.array([[c, -s], [s, c]])


def _explained(corr: np.ndarray, group: list[int], variable: int) -> float:
    """Squared correlation of a variable with the first principal component of a group."""
    if not group:
        return 0.0
    values, vectors = _eigen(corr[np.ix_(group, group)])
    return float((corr[variable, group] @ vectors[:, 0]) ** 2 / max(values[0], 1e-12))


def variable_clusters(data: np.ndarray, names: list[str], limit: float = 1.0) -> list[list[str]]:
    """Clusters of correlated variables.

    A cluster whose second eigenvalue exceeds ``limit`` is split by its two first rotated
    components; then variables move to the cluster whose component explains more of them.
    """
    data = data.astype(float)
    spread = data.std(0)
    data = (data - data.mean(0)) / np.where(spread > 0, spread, 1)
    corr = np.nan_to_num(np.corrcoef(data, rowvar=False)).reshape(len(names), len(names))
    np.fill_diagonal(corr, 1.0)
    clusters, closed = [list(range(len(names)))], set()
    while True:
        second = [(-np.inf if len(c) < 2 or tuple(c) in closed else _eigen(corr[np.ix_(c, c)])[0][1]) for c in clusters]
        worst = int(np.argmax(second))
        if second[worst] <= limit:
            return [[names[k] for k in c] for c in clusters]
        whole = clusters[worst]
        values, vectors = _eigen(corr[np.ix_(whole, whole)])
        loadings = _quartimax(vectors[:, :2] * np.sqrt(np.maximum(values[:2], 0)))
        sides = np.abs(loadings).argmax(1)
        parts = [[v for v, s in zip(whole, sides, strict=True) if s == k] for k in (0, 1)]
        for _ in range(10):
            moved = False
            for v in whole:
                own = 0 if v in parts[0] else 1
                if len(parts[own]) > 1 and _explained(corr, parts[1 - own], v) > _explained(corr, parts[own], v) + 1e-12:
                    parts[own].remove(v)
                    parts[1 - own].append(v)
                    moved = True
            if not moved:
                break
        if not parts[0] or not parts[1]:
            closed.add(tuple(whole))
            continue
        clusters[worst : worst + 1] = [sorted(p) for p in parts]


@dataclass(frozen=True)
class Features:
    """Numeric attributes in order of importance, and what each stands for."""

    ranked: tuple[tuple[str, float], ...] = ()
    stands_for: tuple[tuple[str, tuple[str, ...]], ...] = ()
    special: tuple[str, ...] = ()

    def beside(self, attribute: str) -> tuple[str, ...]:
        return dict(self.stands_for).get(attribute, ())


def choose(rows: DataFrame, columns: list[str], special: set[str], sample_rows: int = 10_000, seed: int = 1, trees: int = 500, depth: int = 10) -> Features:
    """Cluster and rank numeric attributes on a sample of at most ``sample_rows`` rows.

    With three or more attributes, constant ones go and the rest are clustered; of each cluster,
    an attribute of the special node stands for the others, or else that with the
    highest entropy, then the last by name. A random forest that tells the sides apart
    ranks what remains.
    """
    if not columns:
        return Features()
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    pandas = sampling.uniform(rows, sample_rows, seed).select("is_user", *numbers).toArrow().to_pandas()
    stands: dict[str, tuple[str, ...]] = {}
    if len(columns) >= 3:
        kept = [c for c in columns if pandas[c].nunique() > 1]
        clusters = variable_clusters(pandas[kept].to_numpy(), kept) if len(kept) > 1 else [kept] if kept else []
        for cluster in clusters:
            order = sorted(cluster, key=lambda c: (c in special, value_entropy(pandas[c].to_numpy()), c), reverse=True)
            stands[order[0]] = tuple(order[1:])
    else:
        stands = {c: () for c in columns}
    inputs = list(stands)
    if not inputs:
        return Features()
    if pandas["is_user"].nunique() < 2:
        weights = np.zeros(len(inputs))
    else:
        weights = importances(pandas[inputs].to_numpy(float), (pandas["is_user"] == "yes").to_numpy(float), trees, depth, seed=seed, spark=rows.sparkSession)
    ranked = sorted(zip(inputs, map(float, weights), strict=True), key=lambda x: (-x[1], x[0]))
    return Features(tuple(ranked), tuple(stands.items()), tuple(c for c, _ in ranked if c in special))
