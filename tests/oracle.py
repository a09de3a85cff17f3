"""Comparing a query with its SQL on DuckDB."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def assert_same(df, con, sql):
    names = sorted(df.columns)
    rel = con.sql(sql)
    assert names == sorted(rel.columns)
    want = rel.select(", ".join(f'"{n}"' for n in names)).fetchall()
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(tuple(map(norm, r)) for r in got) == sorted(tuple(map(norm, r)) for r in want)
