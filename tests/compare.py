"""Run queries and their SQL twins side by side."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = (tuple(_plain(r[i]) for i in order) for r in rows)
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), _rows(columns, cursor.fetchall())


def difference(left, right) -> str:
    """Empty when equal; else what differs first."""
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows vs {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"columns {left[0]}\n  {a}\n  {b}"
    return ""
