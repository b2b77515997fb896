"""Comparison of a Spark result with DuckDB's, as sorted rows of text."""

import math
import os

import duckdb


def text(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return "null"
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}" if v != int(v) else str(int(v))
    if isinstance(v, list):
        return str([text(x) for x in v])
    return str(v)


def rows(pdf, columns):
    return sorted(tuple(text(x) for x in r) for r in pdf[columns].itertuples(index=False))


def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def assert_same(spark_df, sql, con):
    got, want = spark_df.toPandas(), con.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
