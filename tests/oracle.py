"""Compare a query with its SQL in DuckDB, columns by name and rows in any order."""

import datetime
import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        source = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{source}'")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(value(r[k]) for k in order) for r in rows), key=str)


def ours(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def theirs(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())
