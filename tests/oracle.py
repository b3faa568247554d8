"""Runs SQL over the tables with DuckDB and compares it with a DataFrame, order aside."""

import datetime
import decimal
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return plain(list(v.values()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(table, columns):
    return sorted(tuple(plain(r[c]) for c in columns) for r in table)


def same(df, con, sql):
    found = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    want = [dict(zip(found.columns, r)) for r in found.fetchall()]
    assert rows([r.asDict() for r in df.collect()], columns) == rows(want, columns)
