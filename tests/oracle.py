"""Runs a query and its SQL side by side."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def same(df, con, sql):
    """(columns agree, Spark's rows, DuckDB's rows), rows sorted, columns by name."""
    cols = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    at = [names.index(c) for c in cols] if sorted(names) == cols else []
    return sorted(names) == cols, ours, sorted(tuple(plain(r[k]) for k in at) for r in got.fetchall())
