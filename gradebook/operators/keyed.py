"""Per-key building blocks: restriction, newest-n, first and last row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def restrict(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keep the rows whose key is in ``keys``."""
    return df.join(keys, on, "left_semi")


def optional_filter(df: DataFrame, **equals) -> DataFrame:
    """Equality filters for the arguments that are given."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def top_per_key(
    df: DataFrame, key: str | Sequence[str], order: Sequence[Column], n: int, position: str = "position"
) -> DataFrame:
    """The first ``n`` rows of every key with their position.

    ``order`` must end in a unique column. Spark limits each input task to ``n``
    rows per key before the shuffle, so a hot key sends few rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(window)).where(F.col(position) <= n)


def recent_per_key(df: DataFrame, key: str, ts: str, n: int = 5) -> DataFrame:
    """The newest ``n`` rows per key, newest first, equal times by higher id."""
    return top_per_key(df, key, [F.desc(ts), F.desc("id")], n)


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, key, order, 1, "_position").drop("_position")


def last_per_key(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The last change per key in order of arrival."""
    return first_per_key(df, key, [F.desc("seq")])
