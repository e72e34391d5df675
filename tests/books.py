"""Small gradebooks from literal rows."""

from __future__ import annotations

from datetime import datetime

from gradebook.sources.schema import BATCHES, TABLES
from gradebook.sources.tables import Gradebook

T0 = datetime(2024, 1, 1)


def book(spark, **rows) -> Gradebook:
    """Tables from lists of tuples; tables not given are empty."""
    return Gradebook(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in TABLES.items()})


def batch(spark, kind: str, rows: list[tuple], columns: str | None = None):
    """A change batch; ``columns`` names the given ones, the others are NULL."""
    names = [part.split()[0] for part in BATCHES[kind].split(", ")]
    given = columns.split() if columns else names
    full = [tuple(dict(zip(given, row)).get(name) for name in names) for row in rows]
    return spark.createDataFrame(full, BATCHES[kind])


def student(i, name=None, matric="", program=None):
    return (i, name or f"S{i}", f"s{i}@x", f"A{i}" if matric == "" else matric, program, "student")


def course(i, name=None):
    return (i, f"C{i:03d}", name or f"Course {i}", 1, 2024, T0)


def enrolment(user, course_id, role="student"):
    return (user * 100 + course_id, user, course_id, role)


def assessment(i, course_id, max_mark=100, weight=10, kind="quiz"):
    return (i, course_id, f"A{i}", kind, max_mark, weight, T0)


def mark(assessment_id, student_id, value):
    return (student_id * 1000 + assessment_id, assessment_id, student_id, value, T0)


def final(course_id, student_id, value, gpa=None, id=None):
    return (id or student_id * 100 + course_id, course_id, student_id, value, gpa)


def rows(df, *columns) -> list[tuple]:
    """All rows as sorted tuples, NULLs first."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: [(v is not None, v) for v in r])
