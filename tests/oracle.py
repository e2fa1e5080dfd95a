"""Comparison of a query with its SQL in DuckDB, by value and without order."""

import datetime as dt
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir=DATA):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, dt.datetime) and x.time() == dt.time() and x.tzinfo is None:
        return x.date()
    return x


def check(spark, query, sql, sf_dir=DATA):
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=str)
    result = duck(sf_dir).sql(sql)
    assert sorted(result.columns) == names
    at = [result.columns.index(n) for n in names]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
