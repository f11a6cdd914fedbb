"""Run a query on Spark and its oracle on DuckDB and compare the rows, order aside."""

from __future__ import annotations

import math

import duckdb

from rankloom.plans.views import TABLES

_connections: dict = {}


def duck(sf_dir: str):
    if sf_dir not in _connections:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        _connections[sf_dir] = con
    return _connections[sf_dir]


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, sql: str, sf_dir: str) -> str | None:
    """None if equal, else a short account of the difference."""
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(sf_dir).execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} != {len(want)}; only spark {sorted(a - b)[:3]}; only duckdb {sorted(b - a)[:3]}"
    return None if got else "both empty"
