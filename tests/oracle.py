"""Spark results against DuckDB on one data folder."""

import datetime
import decimal
import math
import os

import duckdb
from pyspark.sql import Row


def plain(v):
    if isinstance(v, Row) or isinstance(v, dict):
        return tuple(plain(x) for x in (v.values() if isinstance(v, dict) else v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def connect(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return con


def compare(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())
    assert ours == theirs
    return len(ours)
