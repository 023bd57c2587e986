"""Comparison of a query's rows with its DuckDB SQL."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.11g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    names = found.columns
    expected = rows_of(columns, [dict(zip(names, r, strict=True)) for r in found.fetchall()])
    assert rows_of(columns, [r.asDict() for r in df.collect()]) == expected
