"""Comparison of a query's rows with those of its SQL."""

import glob
import os

import duckdb


def views(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view \"{os.path.basename(f)[:-8]}\" as select * from '{f}'")
    return con


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{v:.6g}"
        return "" if v is None else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def same(con, df, sql):
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.collect(), df.columns) == rows(found.fetchall(), found.columns)
