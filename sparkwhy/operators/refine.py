"""Search for patterns: nominal candidates extended by bounds on numeric attributes."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations, product

from pyspark.sql import DataFrame

from .features import Features
from .patterns import Pattern
from .quantiles import quantiles

Nominal = tuple[tuple[str, object], ...]
Quartiles = dict[Nominal, dict[str, list[float]]]


def quartiles(rows: DataFrame, nominal: Sequence[Nominal], attributes: list[str]) -> Quartiles:
    """Distinct exact quartiles of each attribute among the rows of each nominal pattern, all in a few passes.

    A pattern or attribute without values has none.
    """
    slices = [(tuple(Pattern(nominal=n).parts()), a) for n in nominal for a in attributes]
    found = iter(quantiles(rows, slices))
    return {n: {a: sorted(set(next(found))) for a in attributes} for n in nominal}


def extend(patterns: Sequence[Pattern], ranked: Sequence[tuple[int, str]], found: Quartiles, features: Features) -> list[Pattern]:
    """Each pattern with one more bound, on an attribute later in the ranking than its last."""
    return [
        p.extended(a, op, bound, rank, features.beside(a))
        for p in patterns for rank, a in ranked if rank > p.rank for bound in found[p.nominal].get(a, ()) for op in (">", "<")
    ]


def search(
    nominal: Sequence[Nominal],
    found: Quartiles,
    features: Features,
    special: set[str],
    scored: Callable[[list[Pattern]], list[Pattern]],
    cap: int = 2,
    rate: float = 1.5,
    least_recall: float = 0.0,
) -> list[Pattern]:
    """Patterns of up to ``cap`` numeric bounds that use the special node.

    Level by level, all candidates of a level are scored together; only patterns whose recall is
    above ``least_recall`` are kept and extended, as more predicates can't raise it. A nominal
    pattern without an attribute of the special node first gets a bound on that node's most
    important numeric attribute; if there is none, it leads nowhere.
    """
    order = [a for a, _ in features.ranked]
    width = math.ceil(rate * cap)
    kept: list[Pattern] = []
    start = [Pattern(nominal=n, is_user=s) for n in nominal for s in ("yes", "no")]
    good = [p for p in scored(start) if p.recall > least_recall] if start else []
    with_special = [p for p in good if p.attributes() & special]
    kept += with_special
    level, ranked = with_special, list(enumerate(order))[:width]
    for _ in range(cap):
        tried = extend(level, ranked, found, features)
        level = [p for p in scored(tried) if p.recall > least_recall] if tried else []
        kept += level
    rest = [p for p in good if not p.attributes() & special]
    if features.special and rest:
        first = features.special[0]
        ranked = list(enumerate(a for a in order if a != first))[:width]
        tried = extend(rest, [(-1, first)], found, features)
        level = [p for p in scored(tried) if p.recall > least_recall] if tried else []
        kept += level
        for _ in range(cap - 1):
            tried = extend(level, ranked, found, features)
            level = [p for p in scored(tried) if p.recall > least_recall] if tried else []
            kept += level
    return kept


def search_all(
    nominal: Sequence[Nominal],
    found: Quartiles,
    attributes: Sequence[str],
    special: set[str],
    scored: Callable[[list[Pattern]], list[Pattern]],
    cap: int = 3,
    least_recall: float = 0.0,
) -> list[Pattern]:
    """All combinations of up to ``cap`` attributes, bounds and directions, scored in one go.

    Patterns with numeric bounds have to use the special node; purely nominal ones are exempt.
    """
    tried = [Pattern(nominal=n, is_user=s) for n in nominal for s in ("yes", "no")]
    for n in nominal:
        own = {a for a, _ in n}
        for size in range(1, cap + 1):
            for chosen in combinations(attributes, size):
                if not (own | set(chosen)) & special:
                    continue
                for bounds in product(*[[(a, op, b) for b in found[n].get(a, ()) for op in (">", "<")] for a in chosen]):
                    tried += [Pattern(nominal=n, ordinal=bounds, is_user=s) for s in ("yes", "no")]
    return [p for p in scored(tried) if p.recall > least_recall] if tried else []
