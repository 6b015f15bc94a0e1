"""Runs a query's SQL in DuckDB on the same rows and compares."""

import datetime as dt
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def of_duck(sql, sf=None, **frames):
    con = duckdb.connect()
    con.execute("SET threads TO 2; SET TimeZone='UTC'")
    for t in TABLES if sf else []:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, df in frames.items():
        con.register(name, df.toArrow())
    cur = con.execute(sql)
    return sorted(d[0] for d in cur.description), rows([d[0] for d in cur.description], cur.fetchall())


def of_spark(df):
    return sorted(df.columns), rows(df.columns, df.collect())


def check(df, sql, sf=None, **frames):
    got, want = of_spark(df), of_duck(sql, sf, **frames)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert a == b
