"""Runs a query and its SQL side by side."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def both(spark, query, sql, sf_dir):
    """(columns, rows) of the query and of the SQL, in an order that does not matter."""
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = con.sql(sql)
    order = [found.columns.index(c) for c in columns] if sorted(found.columns) == columns else None
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr) if order is not None else None
    return (columns, mine), (sorted(found.columns), theirs)
