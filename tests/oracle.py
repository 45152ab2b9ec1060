"""The driver's comparison in small: a query's rows against its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"create view {t} as select * from '{p}'")
    r = c.sql(sql)
    return list(r.columns), r.fetchall()


def same(columns, rows, digits=9):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda x: round(x, digits) if isinstance(x, float) else x
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


def check(spark, run, sql, sf):
    df = run(spark, sf)
    assert same(df.columns, [tuple(r) for r in df.collect()]) == same(*rows_of(sql, sf))
