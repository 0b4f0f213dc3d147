"""Compare a query with SQL that an independent engine runs on the same files."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        v = v if v.tzinfo else v.replace(tzinfo=datetime.timezone.utc)
        return round(v.timestamp() * 1e6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(df, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(con, sql, columns):
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
