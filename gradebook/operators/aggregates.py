"""Counts, averages, bands and pivots over whole cohorts.

Measures that end up under a course name are first reduced per course id, so a
shuffle carries one partial row per task and course instead of every exam row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.functions.bands import (
    COMPLETION_BRACKETS,
    COMPLETION_TOP,
    cgpa_band,
    completion_bracket,
    standing,
)
from gradebook.functions.numbers import (
    POINT,
    from_points,
    mean_points,
    reported,
    to_points,
)
from gradebook.functions.scores import FINAL_EXAM_WEIGHT, final_share
from gradebook.operators.facts import (
    PAIR,
    course_assessments,
    course_facts,
    scored_marks,
)
from gradebook.operators.filters import students
from gradebook.operators.joins import courses_of, enrolled, people
from gradebook.sources.tables import Gradebook


def one_row(frames: Sequence[DataFrame]) -> DataFrame:
    """Put one-row frames side by side without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _all_students(db: Gradebook, per_student: DataFrame) -> DataFrame:
    ids = db.users.where("role = 'student'").select(F.col("id").alias("student_id"))
    return ids.join(per_student, "student_id", "left")


def _mean(total: Column, n: Column) -> Column:
    """Mean of micro-points given their sum and number."""
    return F.try_divide(total.cast("double"), n * F.lit(float(POINT)))


def mean_of(value: Column, digits: int) -> Column:
    """Mean of a group's values, rounded; NULL for none."""
    return reported(_mean(F.sum(to_points(value)), F.count(value)), digits)


# Counts


def table_totals(db: Gradebook) -> DataFrame:
    return one_row([
        db.assessments.agg(F.count("*").alias("total_assessments")),
        db.remark_requests.agg(F.count("*").alias("total_remarks")),
        students(db).agg(F.count("*").alias("total_students")),
    ])


def distinct_students(db: Gradebook) -> DataFrame:
    """Number of different enrolled students that have a matric number."""
    known = db.users.where("matric_number IS NOT NULL").select(F.col("id").alias("student_id"))
    return (
        enrolled(db).select("student_id").distinct()
        .join(known, "student_id", "left_semi")
        .agg(F.count("*").alias("total_students"))
    )


def students_by_course(db: Gradebook, ordered: bool = True) -> DataFrame:
    """Enrolments per course name; courses of the same name are merged."""
    per_course = enrolled(db).groupBy("course_id").agg(F.count("student_id").alias("n"))
    rows = per_course.join(courses_of(db, "course_name"), "course_id").groupBy("course_name").agg(
        F.sum("n").alias("student_count"))
    return rows.orderBy("course_name") if ordered else rows


def course_count_per_student(db: Gradebook) -> DataFrame:
    counts = enrolled(db).groupBy("student_id").agg(F.count("*").alias("total_courses"))
    return _all_students(db, counts).fillna(0, ["total_courses"])


def final_mark_stats_per_student(db: Gradebook) -> DataFrame:
    """Average, highest and lowest final mark, 0 without exams."""
    mark = F.col("final_mark")
    stats = db.final_exams.groupBy("student_id").agg(
        mean_of(mark, 2).alias("average_mark"),
        F.max(mark).cast("double").alias("highest_mark"),
        F.min(mark).cast("double").alias("lowest_mark"))
    return _all_students(db, stats).fillna(0.0, ["average_mark", "highest_mark", "lowest_mark"])


def avg_final_mark_per_student(db: Gradebook) -> DataFrame:
    """Average final mark per student to 4 decimals, NULL without exams."""
    stats = db.final_exams.groupBy("student_id").agg(mean_of(F.col("final_mark"), 4).alias("average_final_mark"))
    return _all_students(db, stats)


def pending_remarks_per_student(db: Gradebook) -> DataFrame:
    counts = db.remark_requests.where("status = 'pending'").groupBy("student_id").agg(
        F.count("*").alias("pending_remarks"))
    return _all_students(db, counts).fillna(0, ["pending_remarks"])


# Progress and completion


def assessment_completion(db: Gradebook) -> DataFrame:
    """Assessments and existing marks rows per (student, course); empty courses drop out.

    Ids are unique, so plain counts equal distinct counts.
    """
    totals = db.dim("assessments", course_assessments(db).select(
        "course_id", F.col("assessment_count").alias("total")))
    return (
        course_facts(db, finals=False)
        .join(totals, "course_id")
        .join(courses_of(db, "course_code", "course_name"), "course_id")
        .select("student_id", "course_id", "course_code", "course_name", "total",
                F.col("marks_count").alias("completed"))
    )


def _progress(db: Gradebook, role: str | None, weight: Column) -> DataFrame:
    final_weight = F.when(F.col("final_mark").isNotNull(), FINAL_EXAM_WEIGHT).otherwise(0)
    return (
        course_facts(db, role=role, remarks=True)
        .join(courses_of(db, "course_name"), "course_id")
        .join(db.dim("assessments", course_assessments(db)), "course_id", "left")
        .join(people(db, F.col("name").alias("student_name"), "matric_number"), "student_id")
        .select(
            "student_id", "student_name", "matric_number", "course_id", "course_name",
            F.coalesce("assessment_count", F.lit(0)).alias("assessment_count"),
            "marks_count", F.coalesce("mark_sum", F.lit(0)).alias("total_marks"),
            "final_mark", "gpa", "remark_count",
            (F.coalesce(weight, F.lit(0)) + final_weight).cast("bigint").alias("total_weight_completed"))
    )


def progress_lecturer(db: Gradebook, ordered: bool = True) -> DataFrame:
    """Progress of every student enrolment.

    The weight is the sum of the course's *different* weights, plus the exam's
    when there is a final mark.
    """
    rows = _progress(db, "student", F.col("distinct_weight_sum"))
    return rows.orderBy("course_name", "student_name", "student_id", "course_id") if ordered else rows


def progress_student(db: Gradebook, ordered: bool = True) -> DataFrame:
    """Progress of every enrolment, whatever its role.

    The weight is that of the assessments with a marks row, plus the exam's.
    """
    rows = _progress(db, None, F.col("marked_weight"))
    return rows.orderBy("course_name", "student_name", "student_id", "course_id") if ordered else rows


def student_totals(db: Gradebook) -> DataFrame:
    """Completion of each student over all enrolled courses; it can exceed 100."""
    per_student = course_facts(db).groupBy("student_id").agg(
        F.coalesce(F.sum("completion_points"), F.lit(0)).alias("mark_points"),
        F.coalesce(to_points(final_share(F.max("final_mark"))), F.lit(0)).alias("final_points"),
        F.coalesce(F.max("gpa"), F.lit(0.0)).alias("gpa"))
    return per_student.join(people(db, F.col("name").alias("student_name"), "matric_number"), "student_id").select(
        "student_id", "student_name", "matric_number",
        from_points(F.col("mark_points")).alias("assessment_weight"),
        from_points(F.col("final_points")).alias("final_weight"),
        from_points(F.col("mark_points") + F.col("final_points")).alias("total_completion"),
        "gpa")


def completion_brackets(db: Gradebook, totals: DataFrame | None = None) -> DataFrame:
    """Number of students per completion bracket; all four are always present."""
    totals = student_totals(db) if totals is None else totals
    labels = [label for _, label in COMPLETION_BRACKETS] + [COMPLETION_TOP]
    bracket = completion_bracket(F.col("total_completion"))
    counted = totals.agg(*[F.count(F.when(bracket == label, 1)).alias(label) for label in labels])
    pairs = F.array(*[
        F.struct(F.lit(label).alias("bracket"), F.col(f"`{label}`").alias("student_count")) for label in labels])
    return counted.select(F.inline(pairs))


def average_completion(db: Gradebook, totals: DataFrame | None = None) -> DataFrame:
    totals = student_totals(db) if totals is None else totals
    mean = mean_points(to_points(F.col("total_completion")))
    return totals.agg(F.coalesce(reported(mean, 1), F.lit(0.0)).alias("avg_completion"))


# Averages per course name


def _mean_by_course_name(db: Gradebook, points: DataFrame, name: str) -> DataFrame:
    """Mean of a (course_id, points) frame per course name, 0 for none, to 4 decimals."""
    per_course = points.groupBy("course_id").agg(
        F.sum("points").alias("total"), F.count("points").alias("n"))
    return (
        db.courses.select(F.col("id").alias("course_id"), "course_name").join(per_course, "course_id", "left")
        .groupBy("course_name")
        .agg(F.coalesce(reported(_mean(F.sum("total"), F.sum("n")), 4), F.lit(0.0)).alias(name))
    )


def avg_final_by_course(db: Gradebook) -> DataFrame:
    points = db.final_exams.select("course_id", to_points(F.col("final_mark")).alias("points"))
    return _mean_by_course_name(db, points, "avg_final_mark")


def avg_gpa_by_course(db: Gradebook) -> DataFrame:
    points = db.final_exams.select("course_id", to_points(F.col("gpa")).alias("points"))
    return _mean_by_course_name(db, points, "avg_gpa")


def avg_completion_by_course(db: Gradebook) -> DataFrame:
    """Mean completion of the students with marks rows; one without any graded mark does not count."""
    final_points = F.coalesce(to_points(final_share(F.col("final_mark"))), F.lit(0))
    points = course_facts(db, only_enrolled=False).where("marks_count > 0").select(
        "course_id", (F.col("completion_points") + final_points).alias("points"))
    return _mean_by_course_name(db, points, "avg_completion")


def avg_cgpa_by_course(db: Gradebook, ordered: bool = True) -> DataFrame:
    """Mean of the students' own means per course name; courses without exams are absent."""
    per_student = db.final_exams.groupBy("course_id", "student_id").agg(_gpa_mean().alias("cgpa"))
    per_course = per_student.groupBy("course_id").agg(
        F.sum(to_points(F.col("cgpa"))).alias("total"), F.count("cgpa").alias("n"))
    rows = per_course.join(courses_of(db, "course_name"), "course_id").groupBy("course_name").agg(
        reported(_mean(F.sum("total"), F.sum("n")), 2).alias("avg_cgpa"))
    return rows.orderBy("course_name") if ordered else rows


def overall_averages(db: Gradebook) -> DataFrame:
    mark, gpa = to_points(F.col("final_mark")), to_points(F.col("gpa"))
    return db.final_exams.agg(
        F.coalesce(reported(mean_points(mark), 1), F.lit(0.0)).alias("avg_final_mark"),
        F.coalesce(reported(mean_points(gpa), 2), F.lit(0.0)).alias("avg_gpa"))


# CGPA


def _gpa_mean() -> Column:
    gpa = F.col("gpa")
    return _mean(F.sum(to_points(gpa)), F.count(gpa))


def cgpa_per_student(db: Gradebook) -> DataFrame:
    """Mean GPA of every student with exam rows, NULL if none is graded."""
    return db.final_exams.groupBy("student_id").agg(_gpa_mean().alias("cgpa"))


def standing_counts(db: Gradebook) -> DataFrame:
    """Students, how many are in each standing, and the mean CGPA, as one row."""
    cgpa = F.col("cgpa")
    level = F.when(cgpa.isNotNull(), standing(cgpa))
    bands = cgpa_per_student(db).agg(
        F.count(F.when(level == "Good Standing", 1)).alias("good_standing"),
        F.count(F.when(level == "Warning", 1)).alias("warning"),
        F.count(F.when(level == "Probation", 1)).alias("probation"),
        reported(mean_points(to_points(cgpa)), 2).alias("avg_cgpa"))
    return one_row([students(db).agg(F.count("*").alias("total_advisees")), bands])


def cgpa_distribution(db: Gradebook) -> DataFrame:
    band = cgpa_band(F.col("cgpa"))
    return cgpa_per_student(db).agg(*[
        F.sum(F.when(band == name, 1).otherwise(0)).alias(name) for name in ("excellent", "good", "average", "low")])


# Pivots, distinct courses, weights


def type_pivot(db: Gradebook) -> DataFrame:
    """Weighted marks per assessment type for each (student, course) with coursework marks."""
    points = F.col("report_points")

    def of_type(kind: str, name: str) -> Column:
        return from_points(F.sum(F.when(F.col("type") == kind, points).otherwise(0))).alias(name)

    return scored_marks(db).where("type <> 'final'").groupBy(*PAIR).agg(
        of_type("assignment", "assignment"), of_type("quiz", "quiz"), of_type("lab", "lab"),
        of_type("exercise", "exercise"), of_type("test", "midterm"),
        from_points(F.sum(points)).alias("total_without_final"))


def courses_with_marks(db: Gradebook, keys: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Courses in which each student has a marks row, newest first."""
    marks = scored_marks(db) if keys is None else scored_marks(db).join(keys, "student_id", "left_semi")
    rows = marks.select(*PAIR).distinct().join(
        courses_of(db, "course_name", "course_code", "semester", "year"), "course_id"
    ).select("student_id", "course_id", "course_name", "course_code", "semester", "year")
    if not ordered:
        return rows
    return rows.orderBy("student_id", F.desc("year"), F.desc("semester"), "course_code", "course_id")


def weights_per_course(db: Gradebook, without_assessment: int | None = None) -> DataFrame:
    """Assessment weight of every course, 0 without assessments, optionally leaving one out."""
    counted = db.assessments
    if without_assessment is not None:
        counted = counted.where(F.col("id") != without_assessment)
    sums = counted.groupBy("course_id").agg(F.sum("weight").alias("total_weight"))
    return db.courses.select(F.col("id").alias("course_id")).join(
        db.dim("assessments", sums), "course_id", "left").fillna(0, ["total_weight"])
