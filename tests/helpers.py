"""Comparison of registered queries with their SQL in DuckDB."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def oracle(sql, folder=DATA):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return sorted(columns), rows_of(columns, got.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])
