"""Grade, standing and completion bands as CASE chains over fixed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lowest mark of each band and what the band gives.
GPA_BANDS = ((85, 4.0), (75, 3.5), (65, 3.0), (55, 2.5), (45, 2.0), (35, 1.5))
GPA_FLOOR = 1.0
LETTER_BANDS = (
    (90, "A+"), (80, "A"), (75, "A-"), (70, "B+"), (65, "B"),
    (60, "B-"), (55, "C+"), (50, "C"), (45, "D"),
)
LETTER_FLOOR = "F"
STANDING_BANDS = ((3.0, "Good Standing"), (2.0, "Warning"))
STANDING_FLOOR = "Probation"
CGPA_BANDS = ((3.5, "excellent"), (3.0, "good"), (2.5, "average"))
CGPA_FLOOR = "low"
# Highest completion of each bracket.
COMPLETION_BRACKETS = ((25, "0-25%"), (50, "26-50%"), (75, "51-75%"))
COMPLETION_TOP = "76-100%"


def _at_least(value: Column, bands: Sequence[tuple], otherwise) -> Column:
    chain = F
    for low, result in bands:
        chain = chain.when(value >= F.lit(low), F.lit(result))
    return chain.otherwise(F.lit(otherwise))


def gpa_from_mark(mark: Column) -> Column:
    return _at_least(mark, GPA_BANDS, GPA_FLOOR)


def letter_grade(total: Column) -> Column:
    return _at_least(total, LETTER_BANDS, LETTER_FLOOR)


def standing(cgpa: Column) -> Column:
    """Standing of an unrounded CGPA; no CGPA counts as probation."""
    return _at_least(cgpa, STANDING_BANDS, STANDING_FLOOR)


def cgpa_band(cgpa: Column) -> Column:
    """Band of a CGPA, NULL without one."""
    return F.when(cgpa.isNotNull(), _at_least(cgpa, CGPA_BANDS, CGPA_FLOOR))


def completion_bracket(total: Column) -> Column:
    chain = F
    for high, label in COMPLETION_BRACKETS:
        chain = chain.when(total <= F.lit(high), F.lit(label))
    return chain.otherwise(F.lit(COMPLETION_TOP))
