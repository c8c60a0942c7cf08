"""Compares a Spark result with DuckDB's, whatever the order of rows and columns."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def database():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    have = [c[0] for c in cursor.description]
    names = sorted(have)
    return names, sorted(tuple(_plain(r[have.index(c)]) for c in names) for r in cursor.fetchall())
