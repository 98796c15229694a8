"""A query's rows held against its SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of_sql(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def same_rows(frame, sf_dir: str, sql: str) -> None:
    names, expected = rows_of_sql(sf_dir, sql)
    columns = sorted(frame.columns)
    assert columns == sorted(names)
    made = [tuple(plain(row[c]) for c in columns) for row in frame.collect()]
    wanted = [tuple(plain(row[names.index(c)]) for c in columns) for row in expected]
    assert sorted(made, key=repr) == sorted(wanted, key=repr)
