"""Run a query in Spark and its SQL twin in DuckDB over the same folder, and compare all rows."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int | float) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}"
    if isinstance(x, list):
        return str([plain(y) for y in x])
    return str(x)


def same(spark, query, sql, sf_dir=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = sorted(tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in result.fetchall())
    df = query(spark, sf_dir)
    got = sorted(tuple(plain(r[n]) for n in sorted(df.columns)) for r in df.collect())
    assert sorted(names) == sorted(df.columns)
    assert got == want
