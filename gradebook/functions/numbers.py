"""Exact sums and reported roundings.

Scores are summed as whole micro-points (BIGINT), so a sum does not depend on
the order in which partial results arrive: a recomputed task gives the same
total, and the hash aggregate keeps a plain long buffer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = 1_000_000


def to_points(score: Column) -> Column:
    """A score as whole micro-points."""
    return F.rint(score * F.lit(float(POINT))).cast("bigint")


def from_points(points: Column) -> Column:
    """Micro-points back to a DOUBLE score."""
    return points / F.lit(float(POINT))


def reported(value: Column, digits: int) -> Column:
    """Round half away from zero on a DECIMAL, shown as DOUBLE."""
    return F.round(value.cast("decimal(18,6)"), digits).cast("double")


def mean_points(points: Column) -> Column:
    """Exact mean of micro-points as a DOUBLE score.

    The outer sum runs over groups that can hold a whole cohort, so it is taken
    in DECIMAL where a BIGINT could overflow.
    """
    total = F.sum(points.cast("decimal(20,0)")).cast("double")
    return F.try_divide(total, F.count(points) * F.lit(float(POINT)))
