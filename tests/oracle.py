"""Runs a query in Spark and its twin in DuckDB and compares rows."""

import datetime
import decimal
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def connect(folder):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in os.listdir(folder):
        con.sql(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return con


def compare(spark, folder, query, sql):
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = connect(folder).sql(sql)
    want = rows_of(r.columns, r.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
