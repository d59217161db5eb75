"""Bounded samples of labelled rows for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_modulo(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; a null counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def by_label(rows: DataFrame, label: str, size: str, most_rows: int, most_bytes: int) -> tuple[DataFrame, dict]:
    """About equally many rows of each label, at most ``most_rows`` and about ``most_bytes`` in all.

    Rows are taken by a hash of their content, so that the same table gives the same
    sample; nothing is shuffled but a count for each label. Returns the sample and how many rows
    each label has in the whole table.
    """
    found = rows.groupBy(label).agg(F.count("*").alias("n"), F.avg(size).alias("mean")).collect()
    counts = {r[label]: r["n"] for r in found if r["n"]}
    if not counts:
        return rows.limit(0), counts
    mean = sum(r["n"] * (r["mean"] or 0) for r in found) / sum(counts.values())
    total = min(most_rows, int(most_bytes / max(mean, 1)) + 1)
    each, left = 0, sorted(counts.values())
    for k, n in enumerate(left):  # what small labels don't need goes to the others
        each = max(each, total // len(left) if k == 0 else each)
        if n < each and k + 1 < len(left):
            each += (each - n) // (len(left) - k - 1)
    spread = 2**20
    hashed = F.pmod(F.xxhash64(*rows.columns), F.lit(spread))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(spread * min(1.0, 0.95 * each / n)) + (n <= each)))])
    return rows.where(hashed < share[F.col(label)]).limit(most_rows), counts
