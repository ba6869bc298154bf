"""Compare a query with its DuckDB SQL: names, count and values, order ignored."""

import datetime
import decimal
from collections import Counter

import duckdb

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps").split()


def plain(v, digits=9):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and digits is not None:
        return round(v, digits)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows, digits=9):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i], digits) for i in order) for r in rows)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for n in NAMES:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    got = con.sql(sql)
    return list(got.columns), got.fetchall()


def assert_same(df, sf_dir, sql, digits=9):
    """``digits``: decimal places of doubles that are compared; None compares them to the bit."""
    names, want = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    a, b = rows_of(df.columns, df.collect(), digits), rows_of(names, want, digits)
    assert a == b, (list((a - b).items())[:5], list((b - a).items())[:5])
