"""Compare a query with its SQL in DuckDB, column by column, rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        if v is None:
            return "\0null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        return str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both give the same; else what differs first."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, got = rows_of(names, found.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        return f"{len(got)} rows, the oracle has {len(want)}"
    return next((f"{g} and {w}" for g, w in zip(got, want, strict=True) if g != w), "")
