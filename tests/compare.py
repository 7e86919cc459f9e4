"""Spark rows against DuckDB rows, as multisets, with columns sorted by name."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}") + 0.0
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return bytes(x) if isinstance(x, (bytearray, memoryview)) else x


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return names, rel.fetchall()


def compare(df, sql: str, sf_dir: str) -> str:
    """What differs, or nothing."""
    names, rows = duck(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)
    if ours == theirs:
        return ""
    a, b = [x for x in ours if x not in set(theirs)][:3], [x for x in theirs if x not in set(ours)][:3]
    return f"{order}: {len(ours)} rows against {len(theirs)}; ours alone {a}; theirs alone {b}"
