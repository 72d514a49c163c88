"""Run registered queries in Spark and DuckDB and compare their rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, round(float(v), 5) + 0.0)
    return (3, str(v))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple(_key(v) for v in r))


def differences(df, con, sql: str, tol: float = 2e-6) -> list[str]:
    """Readable mismatches between a DataFrame and a DuckDB query; empty if equal."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = _rows(names, res.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    out = []
    if len(want) != len(got):
        out.append(f"{len(got)} rows against {len(want)}")
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            ka, kb = _key(a), _key(b)
            if ka[0] == kb[0] == 2:
                same = abs(a - b) <= tol * max(1.0, abs(b))
            else:
                same = ka == kb
            if not same:
                out.append(f"{g} against {w}")
                break
        if len(out) > 3:
            break
    return out
