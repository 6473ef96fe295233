"""Comparison of a query with its DuckDB SQL on the given tables."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder=DATA):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def _cell(x):
    if pd.isna(x):
        return "~"
    if isinstance(x, bool | int | float) or hasattr(x, "dtype"):
        return f"{float(x):.6f}"
    return str(x)


def same(spark, run, sql, folder=DATA):
    got, want = run(spark, folder).toPandas(), connect(folder).execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(tuple(map(_cell, r)) for r in d[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
