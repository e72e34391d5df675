"""Writers for reports and for tables after a batch of changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_report_json(df: DataFrame, pretty: bool = False) -> DataFrame:
    """One JSON text per row; NULL fields stay visible."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return df.select(F.to_json(F.struct(*df.columns), options).alias("value"))


def write_report_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    to_report_json(df, pretty).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a table version to a directory that does not exist yet.

    A changed table is computed from the directory of its previous version, so
    an existing directory is refused rather than overwritten while it is read.
    """
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
