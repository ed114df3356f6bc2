"""Comparison of a query with its SQL, as multisets of rows with sorted columns."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(folder=DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    if type(v).__name__ == "Decimal":
        return text(float(v))
    return str(v)


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(text(r[i]) for i in order) for r in values)


def assert_same(df, sql, con):
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.collect(), df.columns) == rows(relation.fetchall(), relation.columns)
