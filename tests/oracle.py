"""Compares queries with their SQL, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(0.0 if value == 0 else value) if value != int(value) or abs(value) > 1e15 else str(int(value))
    if isinstance(value, bool):
        return str(value)
    return None if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def differences(df, sql: str, con) -> str:
    """Empty if equal."""
    answer = con.sql(sql)
    want_columns, want = rows_of(answer.columns, answer.fetchall())
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if columns != want_columns:
        return f"columns {columns} against {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {got[:2]} {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(want)} rows differ: {bad[:2]}" if bad else ""
