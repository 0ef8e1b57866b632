"""Compares a Spark query with its SQL on the same tables, column by column, in any row order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    expected = con.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(expected.columns, expected.fetchall())
    assert len(mine) == len(theirs)
    differ = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not differ, f"{len(differ)} of {len(mine)} rows differ, first: {differ[:2]}"
