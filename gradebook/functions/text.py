"""Text cleaning, missing-value tests and message texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from user text, and the exam notice.
TRIM_CHARS = " \t\n\r\0\x0b"
EXAM_NOTICE_TITLE = "Final Exam Mark Updated"
EXAM_NOTICE_FORMAT = "Your final exam mark for %s has been recorded. GPA: %s"


def clean_text(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM_CHARS))


def is_missing(value: Column) -> Column:
    """NULL, empty text and zero all count as not given."""
    return F.coalesce(value.cast("string").isin("", "0"), F.lit(True))


def is_blank(text: Column) -> Column:
    """NULL or nothing left after trimming."""
    return F.coalesce(clean_text(text) == "", F.lit(True))


def gpa_text(gpa: Column) -> Column:
    """A GPA without trailing zeros: 4, 3.5."""
    return F.call_function("format_number", gpa, F.lit("#.##"))


def exam_notice(course_name: Column, course_id: Column, gpa: Column) -> Column:
    shown = F.coalesce(course_name, F.concat(F.lit("Course ID "), course_id.cast("string")))
    return F.format_string(EXAM_NOTICE_FORMAT, shown, gpa_text(gpa))
