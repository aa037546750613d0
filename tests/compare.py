"""Spark's rows against DuckDB's."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def differences(df, con, sql: str, show: int = 3) -> list[str]:
    """What differs; empty if nothing does."""
    rel = con.sql(sql)
    names, other = list(rel.columns), rel.fetchall()
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    mine, theirs = rows(df.columns, df.collect()), rows(names, other)
    if len(mine) != len(theirs):
        out.append(f"{len(mine)} rows and {len(theirs)}")
    bad = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b]
    if bad:
        out += [f"{len(bad)} rows differ"] + [f"{a} | {b}" for a, b in bad[:show]]
    return out
