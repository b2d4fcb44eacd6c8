"""A query's rows beside those of its SQL."""

import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return "\0" if v is None else str(v)


def sql_rows(folder, sql):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def same(df, folder, sql):
    got, want = spark_rows(df), sql_rows(folder, sql)
    assert got[0] == want[0]
    assert got[1] == want[1]
