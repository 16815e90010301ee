"""Compares a query with its reference SQL: names, types, number of rows, values in any order."""

from __future__ import annotations

import pathlib

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = pathlib.Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(t: pa.DataType) -> str:
    for name, test in (
        ("bool", pa.types.is_boolean), ("int", pa.types.is_integer), ("float", pa.types.is_floating),
        ("text", lambda x: pa.types.is_string(x) or pa.types.is_large_string(x)),
    ):
        if test(t):
            return name
    return str(t)


def _rows(table: pa.Table, columns: list[str]) -> list[tuple]:
    return sorted(zip(*[table[c].to_pylist() for c in columns], strict=True), key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    got = spark_df.toArrow()
    want = con.execute(sql).to_arrow_table()
    columns = sorted(got.column_names)
    if columns != sorted(want.column_names):
        return f"columns {columns} vs {sorted(want.column_names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for c in columns:
        kinds = _kind(got.schema.field(c).type), _kind(want.schema.field(c).type)
        if kinds[0] != kinds[1]:
            return f"type of {c}: {kinds[0]} vs {kinds[1]}"
    for a, b in zip(_rows(got, columns), _rows(want, columns), strict=True):
        if a != b:
            return f"first difference in {columns}: {a} vs {b}"
    return None
