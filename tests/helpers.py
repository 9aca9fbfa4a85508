"""Results side by side: Spark's rows against DuckDB's over the same Parquet tables."""

import decimal
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def database(folder):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(x):
    if x is None:
        return "null"
    if isinstance(x, (float, decimal.Decimal)) and not isinstance(x, bool):
        return repr(float(x))
    return str(x)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def rows_of_duckdb(relation):
    cols = sorted(relation.columns)
    at = [relation.columns.index(c) for c in cols]
    return cols, sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
