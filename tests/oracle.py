"""Spark results against DuckDB on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connection(sf_dir=SF):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"create view {t} as select * from read_parquet('{p}')")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr(tuple(r[c] for c in names)) for r in table.select(names).to_pylist())


def assert_equal(df, sql, sf_dir=SF):
    got, want = rows(df.toArrow()), rows(connection(sf_dir).sql(sql).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]
