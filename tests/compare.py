"""Results of Spark and DuckDB held against each other, whatever the order of rows and columns."""

import os

import duckdb

DATA = os.environ.get("BELLWETHER_TESTDATA", "/root/testdata/sf0.001")


def connect(d=DATA):
    con = duckdb.connect()
    for f in os.listdir(d):
        rest = "/*.parquet" if os.path.isdir(f"{d}/{f}") else ""
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}{rest}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_duckdb(con, sql):
    r = con.sql(sql)
    names = r.columns
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
