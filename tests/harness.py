"""Run queries beside their SQL checks and compare whole results."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else (0.0 if x == 0 else float(f"{x:.12g}"))
    if isinstance(x, int) and not isinstance(x, bool):
        return x
    if type(x).__name__ == "Decimal":
        return float(x)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, fn, sql):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = bag(got_cols, got), bag(want_cols, want)
    if a != b:
        return (
            f"rows {len(got)} vs {len(want)}; only spark {list((a - b).items())[:3]}; "
            f"only sql {list((b - a).items())[:3]}; columns {sorted(got_cols)}"
        )
    types = {c: t for c, t in df.dtypes if t.startswith("decimal")}
    if types:
        return f"decimal output {types}"
    return f"empty result" if not got else None
