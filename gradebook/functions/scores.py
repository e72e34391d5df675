"""The score definitions. They differ on purpose and are kept apart.

=================== ==================================================
score_ratio         mark / max * weight, used by rankings
score_rounded_item  the same, every item rounded to 2 before the sum
score_completion    weight share of a percentage, used by completion
score_report        mark * weight / 100, ignores max_mark
score_percent       mark / max * 100, used by trends
=================== ==================================================

Each multiplies before it divides; a zero max_mark gives NULL, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradebook.functions.numbers import reported

# Weights in percent.
ASSESSMENT_WEIGHT_CAP = 70
FINAL_EXAM_WEIGHT = 30
TOTAL_WEIGHT_CAP = 100


def score_ratio(mark: Column, max_mark: Column, weight: Column) -> Column:
    return F.try_divide(mark * weight, max_mark)


def is_gradable(mark: Column, max_mark: Column, weight: Column | None = None) -> Column:
    """True when a mark can be scored: mark given, max positive, weight given."""
    ok = mark.isNotNull() & F.coalesce(max_mark > 0, F.lit(False))
    return ok if weight is None else ok & weight.isNotNull()


def score_rounded_item(mark: Column, max_mark: Column, weight: Column) -> Column:
    scored = F.when(is_gradable(mark, max_mark, weight), score_ratio(mark, max_mark, weight))
    return reported(scored, 2)


def score_completion(mark: Column, max_mark: Column, weight: Column) -> Column:
    return F.try_divide(mark * weight, max_mark)


def final_share(final_mark: Column) -> Column:
    """The final exam's part of a completion score."""
    return final_mark * F.lit(FINAL_EXAM_WEIGHT) / F.lit(100)


def score_report(mark: Column, weight: Column) -> Column:
    return mark * weight / F.lit(100)


def score_percent(mark: Column, max_mark: Column) -> Column:
    return F.try_divide(mark * F.lit(100), max_mark)
