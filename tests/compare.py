"""Rows of a query and of its SQL in another engine, made comparable."""

from __future__ import annotations

import math
import os


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def engine(folder: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def rows_of(df) -> tuple[list[str], list]:
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(c, sql: str) -> tuple[list[str], list]:
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    cols = sorted(names)
    at = [names.index(x) for x in cols]
    return cols, sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
