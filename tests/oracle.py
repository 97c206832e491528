"""Comparison of a query with its SQL in DuckDB, row by row."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(path=DATA):
    con = duckdb.connect()
    for t in TABLES:
        file = f"{path}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{file + '/*.parquet' if os.path.isdir(file) else file}'")
    return con


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if pd.api.types.is_scalar(v) and pd.isna(v) else round(float(v), 9) if isinstance(v, float) else v if isinstance(v, (int, str)) else str(v) for v in r))
    return sorted(out, key=repr)


def same(spark, name, query, sql, path=DATA):
    got, want = query(spark, path).toPandas(), connect(path).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    assert rows(got) == rows(want), name
