"""Compares a query with its SQL on DuckDB, as multisets of rows with columns in alphabetical order."""

import math

import duckdb

from tesserine.session import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def differences(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted([plain(r[c]) for c in columns] for r in df.collect())
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall())
    return [] if ours == theirs else [x for x in ours if x not in theirs][:3] + [x for x in theirs if x not in ours][:3] or ["number of copies"]
