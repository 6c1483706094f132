"""Holds queries against their SQL, as sets of rows with columns by name."""

from __future__ import annotations

import math
import os

import duckdb


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def of_spark(df):
    return rows_of(df.columns, df.collect())


def of_duckdb(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        table, path = name.split(".")[0], f"{sf_dir}/{name}"
        con.execute(f"create view {table} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got = con.execute(sql)
    return rows_of([c[0] for c in got.description], got.fetchall())
