"""Runs a query in Spark and its SQL in DuckDB over the same tables."""

import glob
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from '{p}'")
    return con


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols, (names, cols)
    order = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    assert want, "the query is vacuous"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, (len(bad), bad[:2])
