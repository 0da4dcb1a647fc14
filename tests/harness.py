"""Runs a query and its SQL over the same tables and compares rows without order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = oracle(sf_dir).sql(sql)
    return got, rows(rel.columns, rel.fetchall())
