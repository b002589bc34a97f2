"""Compare a query's rows with its DuckDB counterpart, without regard to order."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def normal(df):
    df = df.reindex(sorted(df.columns), axis=1)

    def text(x):
        if x is None or x != x:
            return "NULL"
        if isinstance(x, float):
            return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.6f}"
        return str(x)

    for c in df.columns:
        df[c] = df[c].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def check(spark, con, sf_dir, query, sql):
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    assert normal(ours).equals(normal(theirs))
