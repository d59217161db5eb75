"""Comparing a query with its SQL in DuckDB, rows in any order."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(directory):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(directory) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else float(f"{float(value):.9g}")
    return str(value)[:19] if hasattr(value, "isoformat") else value


def same_rows(frame, con, sql):
    columns = sorted(frame.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in frame.collect()]
    order = lambda t: tuple((v is None, str(v)) for v in t)
    assert sorted(got, key=order) == sorted(expected, key=order)
