"""Listings that join the tables.

Small dimensions (courses, assessments) are broadcast only after their row count
was checked; people tables are joined as Spark sees fit. Global orders end in a
unique id, so a range sort can split any hot course or name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.sources.tables import BROADCAST_ROWS, Gradebook, has_at_most


def courses_of(db: Gradebook, *columns: str) -> DataFrame:
    """Courses keyed by ``course_id``, ready to join as a dimension."""
    return db.dim("courses", db.courses.select(F.col("id").alias("course_id"), *columns))


def assessments_of(db: Gradebook, *columns: str) -> DataFrame:
    """Assessments keyed by ``assessment_id``, ready to join as a dimension."""
    return db.dim("assessments", db.assessments.select(F.col("id").alias("assessment_id"), *columns))


def people(db: Gradebook, *columns: str, key: str = "student_id") -> DataFrame:
    return db.users.select(F.col("id").alias(key), *columns)


def enrolled(db: Gradebook, role: str | None = "student") -> DataFrame:
    """(student, course) pairs with that enrolment role, or with any role."""
    rows = db.course_user if role is None else db.course_user.where(F.col("role") == role)
    return rows.select(F.col("id").alias("enrolment_id"), F.col("user_id").alias("student_id"), "course_id")


def enrolments(db: Gradebook) -> DataFrame:
    """Enrolments of users whose own role is student."""
    people_names = db.users.where("role = 'student'").select(
        F.col("id").alias("user_id"), F.col("name").alias("student_name"))
    return (
        db.course_user.select("id", "user_id", "course_id")
        .join(courses_of(db, "course_name"), "course_id")
        .join(people_names, "user_id")
        .select("id", "student_name", "course_name")
    )


def enrolled_students(db: Gradebook, ordered: bool = True) -> DataFrame:
    """Student enrolments with names, by course and student name."""
    rows = (
        enrolled(db)
        .join(courses_of(db, "course_code", "course_name"), "course_id")
        .join(people(db, F.col("name").alias("student_name"), "matric_number"), "student_id")
        .select("enrolment_id", "student_id", "student_name", "matric_number",
                "course_id", "course_code", "course_name")
    )
    return rows.orderBy("course_name", "student_name", "enrolment_id") if ordered else rows


def course_roster(db: Gradebook, course_keys: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Students of each course by name."""
    rows = enrolled(db) if course_keys is None else enrolled(db).join(course_keys, "course_id", "left_semi")
    rows = rows.select("course_id", "student_id").join(people(db, "name", "matric_number"), "student_id")
    rows = rows.select("course_id", "student_id", "name", "matric_number")
    return rows.orderBy("course_id", "name", "student_id") if ordered else rows


def courses_of_students(db: Gradebook, keys: DataFrame | None = None) -> DataFrame:
    """Enrolled courses of every student."""
    rows = enrolled(db) if keys is None else enrolled(db).join(keys, "student_id", "left_semi")
    return rows.join(
        courses_of(db, "course_code", "course_name", "semester", "year"), "course_id"
    ).select("student_id", "course_id", "course_code", "course_name", "semester", "year")


def mark_sheet(db: Gradebook, zero_fill: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """Every assessment of each enrolled course with the student's mark, if any.

    With ``pairs`` the requested (student_id, course_id) pairs, enrolled or not.
    """
    sheet = _course_assessments(db, pairs, "title", "type", "max_mark", "weight")
    rows = sheet.join(
        db.marks.select("student_id", "assessment_id", "mark_obtained"),
        ["student_id", "assessment_id"], "left")
    mark = F.col("mark_obtained")
    return rows.select(
        "student_id", "course_id", "assessment_id", "title", "type", "max_mark", "weight",
        F.coalesce(mark, F.lit(0)).alias("mark_obtained") if zero_fill else mark)


def _course_assessments(db: Gradebook, pairs: DataFrame | None, *columns: str) -> DataFrame:
    """The assessments of each pair's course; the pairs are the enrolments unless given."""
    per_course = db.dim("assessments", db.assessments.select(
        F.col("id").alias("assessment_id"), "course_id", *columns))
    return (enrolled(db) if pairs is None else pairs).select("student_id", "course_id").join(per_course, "course_id")


def student_course_header(db: Gradebook, pairs: DataFrame, with_final: bool = True) -> DataFrame:
    """Names for requested (student_id, course_id) pairs, enrolled or not.

    Pairs naming an unknown student or course are dropped. With ``with_final``
    the final mark and GPA follow, absent ones shown as 0 and a missing matric
    number as empty text.
    """
    rows = (
        pairs.select("student_id", "course_id")
        .join(courses_of(db, "course_code", "course_name"), "course_id")
        .join(people(db, F.col("name").alias("student_name"), "matric_number"), "student_id")
    )
    columns = ["student_id", "student_name", "matric_number", "course_id", "course_code", "course_name"]
    if not with_final:
        return rows.select(*columns)
    finals = db.final_exams.select("student_id", "course_id", "final_mark", "gpa")
    return rows.join(finals, ["student_id", "course_id"], "left").select(*columns, "final_mark", "gpa").fillna(
        {"matric_number": "", "final_mark": 0, "gpa": 0.0})


def assignment_grid(db: Gradebook) -> DataFrame:
    """Student x assessment of each course with a flag for an existing marks row."""
    given = db.marks.select("student_id", "assessment_id", F.lit(True).alias("assigned"))
    return (
        _course_assessments(db, None, "title", "type")
        .join(given, ["student_id", "assessment_id"], "left")
        .join(people(db, "name", "matric_number"), "student_id")
        .select("course_id", "student_id", "name", "matric_number", "assessment_id", "title", "type",
                F.coalesce("assigned", F.lit(False)).alias("assigned"))
    )


def final_exam_list(db: Gradebook, ordered: bool = True) -> DataFrame:
    """Final exam rows with names, by course code and name."""
    rows = (
        db.final_exams.select("student_id", "course_id", "final_mark", "gpa")
        .join(courses_of(db, "course_code", "course_name"), "course_id")
        .join(people(db, "name", "matric_number"), "student_id")
        .select("student_id", "name", "matric_number", "course_id", "course_code", "course_name",
                "final_mark", "gpa")
    )
    return rows.orderBy("course_code", "name", "student_id", "course_id") if ordered else rows


def assessments_with_course(db: Gradebook, course_id: int | None = None) -> DataFrame:
    """All assessments with their course name, optionally of one course."""
    rows = db.assessments if course_id is None else db.assessments.where(F.col("course_id") == course_id)
    return rows.join(courses_of(db, "course_name"), "course_id").select(
        *db.assessments.columns, "course_name")


def assessments_of_students(db: Gradebook, ordered: bool = True) -> DataFrame:
    """Assessments of every student's courses, by course code and title."""
    rows = _course_assessments(db, None, "title", "type").join(courses_of(db, "course_code"), "course_id")
    rows = rows.select("student_id", "assessment_id", "title", "type", "course_code")
    return rows.orderBy("student_id", "course_code", "title", "assessment_id") if ordered else rows


def remark_history(db: Gradebook, ordered: bool = True) -> DataFrame:
    """Recheck requests with assessment and course, newest first per student."""
    rows = (
        db.remark_requests
        .join(assessments_of(db, F.col("title").alias("assessment_title"),
                             F.col("type").alias("assessment_type"), "course_id"), "assessment_id")
        .join(courses_of(db, "course_code", "course_name"), "course_id")
        .select("student_id", "id", "message", "status", "created_at", "assessment_title",
                "assessment_type", "course_code", "course_name")
    )
    return rows.orderBy("student_id", F.desc("created_at"), F.desc("id")) if ordered else rows


def already_present(
    changes: DataFrame, base: DataFrame, keys: list[str], small: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """Changes whose key exists in ``base``, and those whose key does not.

    A small batch is broadcast to cut the base down to the batch's keys first, so
    the table is not shuffled. ``small`` tells what the caller already counted.
    """
    stored = base.select(*keys)
    wanted = changes.select(*keys)
    if has_at_most(wanted, BROADCAST_ROWS) if small is None else small:
        stored = stored.join(F.broadcast(wanted.distinct()), keys, "left_semi")
    return changes.join(stored, keys, "left_semi"), changes.join(stored, keys, "left_anti")
