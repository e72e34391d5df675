"""Compares a Spark result with its DuckDB statement, regardless of row order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def oracle_connection(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(directory).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "NULL"
        if isinstance(value, (bool, str)):
            return repr(value)
        if hasattr(value, "isoformat"):
            return pd.Timestamp(value).isoformat()
        return repr(float(value)) if float(value) != int(value) else repr(int(value))

    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def differences(spark_df, connection, statement: str) -> str | None:
    """A description of the first difference, or None."""
    expected = connection.execute(statement).fetchdf()
    actual = spark_df.toPandas()
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} / {sorted(expected.columns)}"
    left, right = _normal(actual), _normal(expected)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for ours, theirs in zip(left, right):
        if ours != theirs:
            return f"row {ours} / {theirs}"
    return None
