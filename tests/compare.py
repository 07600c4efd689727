"""Holds a query's rows against DuckDB's on the same tables, whatever the order."""

import math
import os

import duckdb

from millrace.sources import TABLES


def duck(sf_dir, sql):
    with duckdb.connect() as db:
        for name in TABLES:
            path = f"{sf_dir}/{name}.parquet"
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
        found = db.execute(sql)
        names = [c[0] for c in found.description]
        return names, found.fetchall()


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6f}"
    if isinstance(x, bool):
        return str(x)
    return f"{float(x):.6f}" if hasattr(x, "as_tuple") or isinstance(x, int) else str(x)


def rows(names, table):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(_value(r[k]) for k in order) for r in table)


def assert_equal(df, sf_dir, sql):
    names, table = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    own, other = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, table)
    assert len(own) == len(other)
    assert own == other
