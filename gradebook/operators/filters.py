"""Projections, filters and input checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.functions.scores import is_gradable
from gradebook.functions.text import is_blank, is_missing
from gradebook.sources.tables import Gradebook


def students(db: Gradebook) -> DataFrame:
    return db.users.where("role = 'student'").select("id", "name", "matric_number")


def user_directory(db: Gradebook) -> DataFrame:
    return db.users.select("id", "name", "email", "matric_number", "role", "program")


def staff(db: Gradebook) -> DataFrame:
    return db.users.where("role <> 'student'").select("id", "name", "email", "role")


def in_sets(marks: DataFrame, students: DataFrame, assessments: DataFrame) -> DataFrame:
    """Marks of the given students in the given assessments (both ``id`` frames)."""
    return (
        marks
        .join(assessments.select(F.col("id").alias("assessment_id")), "assessment_id", "left_semi")
        .join(students.select(F.col("id").alias("student_id")), "student_id", "left_semi")
    )


def gradable(df: DataFrame, need_weight: bool = False) -> DataFrame:
    """Rows whose mark can be scored."""
    weight = F.col("weight") if need_weight else None
    return df.where(is_gradable(F.col("mark_obtained"), F.col("max_mark"), weight))


def resolve_matric(
    df: DataFrame, users: DataFrame, students_only: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Add the user id as ``student_id`` for each matric number; unknown ones are rejected."""
    known = users.where("role = 'student'") if students_only else users
    known = known.where("matric_number IS NOT NULL").select(
        F.col("id").alias("student_id"), "matric_number")
    found = df.drop("student_id").join(known, "matric_number")
    unknown = df.join(known, "matric_number", "left_anti").withColumn(
        "reason", F.lit("Student not found"))
    return found, unknown


def required_fields(
    df: DataFrame, columns: Sequence[str], text: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Split records into complete and rejected ones.

    ``columns`` are missing when NULL, empty or zero; ``text`` columns when blank
    after trimming. The reason names the first missing field.
    """
    tests = [(c, is_missing(F.col(c))) for c in columns] + [(c, is_blank(F.col(c))) for c in text]
    first = F.coalesce(*[F.when(test, F.lit(f"{name} is required")) for name, test in tests])
    checked = df.withColumn("reason", first)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")
