"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

from tests.conftest import TABLES


def plain(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(value)
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(found: DataFrame, sql: str, sf_dir: str) -> None:
    with duckdb.connect() as con:
        for name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        asked = con.execute(sql)
        expected = rows_of([c[0] for c in asked.description], asked.fetchall())
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    different = [(a, b) for a, b in zip(got[1], expected[1], strict=True) if a != b]
    assert not different, different[:3]
