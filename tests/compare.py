"""Compares a query's rows with those DuckDB gives for its SQL, order aside."""

import glob
from pathlib import Path

import duckdb


def connect(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {Path(f).stem} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(map(plain, r)) for r in zip(*(table.column(n).to_pylist() for n in names))), key=repr)


def check(spark, sf, query, sql):
    assert rows(query(spark, sf).toArrow()) == rows(connect(sf).execute(sql).to_arrow_table())
