"""Rows of a query and of its DuckDB form, in one order and one spelling."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{source}'")
    return con


def spelled(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([spelled(x) for x in value])
    return None if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([spelled(r[i]) for i in order] for r in rows), key=str)


def agree(spark, con, query, sql, sf_dir):
    df, expected = query(spark, sf_dir), con.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())
