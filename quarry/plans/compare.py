"""Holds a Spark query against its DuckDB counterpart, as tests and development do."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "item") and not isinstance(v, (list, tuple)) and getattr(v, "ndim", 0) == 0:
        return plain(v.item())
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, fn, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = fn(spark, sf_dir)
    rel = duck(sf_dir).sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    got, want = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    if got == want:
        return ""
    a, b = set(got), set(want)
    return f"{len(got)} and {len(want)} rows; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
