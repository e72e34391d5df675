"""Rankings, top-n lists, feeds and trends. Ties are broken by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradebook.functions.bands import standing
from gradebook.functions.numbers import from_points, mean_points, reported, to_points
from gradebook.functions.scores import score_percent
from gradebook.operators.aggregates import cgpa_per_student, student_totals
from gradebook.operators.facts import PAIR, course_facts
from gradebook.operators.filters import gradable
from gradebook.operators.joins import assessments_of, courses_of, enrolled, people
from gradebook.operators.keyed import first_per_key, optional_filter, recent_per_key, top_per_key
from gradebook.operators.positions import number_within
from gradebook.sources.tables import Gradebook


def course_totals(db: Gradebook) -> DataFrame:
    """Total of every student in each enrolled course that has assessments, in micro-points."""
    assessed = db.dim("assessments", db.assessments.select("course_id").distinct())
    totals = course_facts(db).select(
        *PAIR,
        (F.coalesce("ratio_points", F.lit(0))
         + F.coalesce(to_points(F.col("final_mark")), F.lit(0))).alias("total_points"))
    return totals.join(assessed, "course_id", "left_semi").join(people(db, "name"), "student_id").select(
        "course_id", "student_id", "name", "total_points")


def course_rankings(db: Gradebook) -> DataFrame:
    """Rank of every student in each course by total; equal totals get different ranks."""
    return _ranked(db).select(
        "course_id", "student_id", "name",
        reported(from_points(F.col("total_points")), 2).alias("total_mark"), "rank")


def _ranked(db: Gradebook) -> DataFrame:
    return number_within(
        course_totals(db), "course_id", [F.desc("total_points"), F.asc("student_id")], "rank")


def _stats(totals: DataFrame) -> DataFrame:
    return totals.groupBy("course_id").agg(
        F.count("*").alias("total_students"),
        reported(mean_points(F.col("total_points")), 2).alias("class_average"))


def class_stats(db: Gradebook, totals: DataFrame | None = None) -> DataFrame:
    """Class size and mean total of every course, 0 for courses without ranked students.

    ``totals`` are those of ``course_totals``: only courses with assessments have any.
    """
    stats = _stats(course_totals(db) if totals is None else totals)
    return (
        db.courses.select(F.col("id").alias("course_id"), "course_code", "course_name", "semester", "year")
        .join(db.dim("assessments", stats), "course_id", "left")
        .fillna({"total_students": 0, "class_average": 0.0})
    )


def ranked_with_stats(db: Gradebook) -> tuple[DataFrame, DataFrame]:
    """Ranked totals and the class statistics of the same rows."""
    ranked = _ranked(db)
    return ranked, class_stats(db, ranked)


def rank_card(db: Gradebook) -> DataFrame:
    """Own rank, class size and class mean for every student enrolment.

    An enrolment that is not ranked keeps its row, with no rank.
    """
    ranked, stats = ranked_with_stats(db)
    own = enrolled(db).select(*PAIR).join(ranked.select(*PAIR, "rank"), PAIR, "left")
    return own.join(db.dim("courses", stats), "course_id").select(
        "student_id", "course_id", "course_code", "course_name",
        F.col("rank").alias("your_rank"), "total_students", "class_average")


# Newest and best rows per student


def recent_notifications(db: Gradebook, n: int = 5) -> DataFrame:
    rows = db.notifications.select("id", F.col("user_id").alias("student_id"), "title", "message", "created_at")
    return recent_per_key(rows, "student_id", "created_at", n)


def recent_notes(db: Gradebook, n: int = 5) -> DataFrame:
    """The newest notes by creation where the table has that column, else by meeting."""
    stamp = "created_at" if "created_at" in db.advisor_notes.columns else "meeting_date"
    rows = db.advisor_notes.select("id", "student_id", "note", "meeting_date", F.col(stamp).alias("_stamp"))
    return recent_per_key(rows, "student_id", "_stamp", n).drop("_stamp")


def recent_remarks(db: Gradebook, n: int = 5) -> DataFrame:
    rows = (
        db.remark_requests.select("id", "student_id", "assessment_id", "status", "created_at")
        .join(assessments_of(db, F.col("title").alias("assessment_title"), "course_id"), "assessment_id")
        .join(courses_of(db, "course_code"), "course_id")
        .select("id", "student_id", "status", "assessment_title", "course_code", "created_at")
    )
    return recent_per_key(rows, "student_id", "created_at", n)


def top_courses_per_student(db: Gradebook, n: int = 3) -> DataFrame:
    """The ``n`` best final marks of each student."""
    best = top_per_key(
        db.final_exams.select(*PAIR, "final_mark")
        .join(courses_of(db, "course_code", "course_name"), "course_id"),
        "student_id", [F.desc_nulls_last("final_mark"), F.asc("course_id")], n)
    return best.select("student_id", "course_id", "final_mark", "course_code", "course_name", "position")


def first_remark_per_pair(db: Gradebook) -> DataFrame:
    """One recheck request per (student, course): the one with the lowest id."""
    rows = db.remark_requests.select("id", "student_id", "assessment_id", "message", "status").join(
        assessments_of(db, "course_id"), "assessment_id")
    return first_per_key(rows, PAIR, [F.asc("id")])


def final_for_mark_group(db: Gradebook) -> DataFrame:
    """One final mark per (student, course): that of the lowest id."""
    finals = db.final_exams.select("id", *PAIR, "final_mark")
    return first_per_key(finals, PAIR, [F.asc("id")]).drop("id")


# Top and at-risk students


def top_students_by_completion(db: Gradebook, n: int = 5, totals: DataFrame | None = None) -> DataFrame:
    totals = student_totals(db) if totals is None else totals
    return totals.orderBy(F.desc("total_completion"), "student_id").limit(n)


def _cgpa_of_students(db: Gradebook) -> DataFrame:
    rounded = cgpa_per_student(db).select("student_id", reported(F.col("cgpa"), 2).alias("cgpa"))
    people_rows = db.users.where("role = 'student'").select(F.col("id").alias("student_id"), "name", "matric_number")
    return rounded.where("cgpa IS NOT NULL").join(people_rows, "student_id").select(
        "student_id", "name", "matric_number", "cgpa")


def top_students_by_cgpa(db: Gradebook, n: int = 10) -> DataFrame:
    return _cgpa_of_students(db).orderBy(F.desc("cgpa"), "student_id").limit(n)


def at_risk_students(db: Gradebook, ordered: bool = True) -> DataFrame:
    """Students whose CGPA, rounded to 2, is below 2.0, lowest first."""
    rows = _cgpa_of_students(db).where("cgpa < 2.0")
    return rows.orderBy("cgpa", "student_id") if ordered else rows


def advisee_list(db: Gradebook, ordered: bool = True) -> DataFrame:
    """All students with rounded CGPA (0 for none) and standing of the unrounded CGPA."""
    rows = (
        db.users.where("role = 'student'").select(
            F.col("id").alias("user_id"), F.col("name").alias("student_name"),
            F.col("matric_number").alias("student_id"), "program")
        .join(cgpa_per_student(db).withColumnRenamed("student_id", "user_id"), "user_id", "left")
        .select("user_id", "student_name", "student_id", "program",
                F.coalesce(reported(F.col("cgpa"), 2), F.lit(0.0)).alias("cgpa"),
                standing(F.col("cgpa")).alias("status"))
    )
    return rows.orderBy("student_name", "user_id") if ordered else rows


# Feeds and trends


def notification_feed(db: Gradebook, keys: DataFrame | None = None) -> DataFrame:
    """Notifications of each user, newest first."""
    rows = db.notifications if keys is None else db.notifications.join(keys, "user_id", "left_semi")
    return rows.select("user_id", "id", "title", "message", "is_read", "created_at").orderBy(
        "user_id", F.desc("created_at"), F.desc("id"))


def note_feed(db: Gradebook, keys: DataFrame | None = None, course_id: int | None = None) -> DataFrame:
    """Advisor notes of each student, newest first, optionally of one course.

    They are ordered by creation where the table has that column, else by meeting.
    """
    rows = optional_filter(db.advisor_notes, course_id=course_id)
    rows = rows if keys is None else rows.join(keys, "student_id", "left_semi")
    stamp = "created_at" if "created_at" in rows.columns else "meeting_date"
    return rows.orderBy("student_id", F.desc(stamp), F.desc("id"))


def course_catalog(db: Gradebook, by_term: bool = False) -> DataFrame:
    """Courses by creation, newest first, or by year, semester and code."""
    if by_term:
        return db.courses.select("id", "course_code", "course_name", "semester", "year").orderBy(
            F.desc("year"), F.desc("semester"), "course_code", "id")
    return db.courses.orderBy(F.desc("created_at"), F.desc("id"))


def performance_trend(db: Gradebook) -> DataFrame:
    """Each student's graded assessments in order of creation, with the score in percent.

    A student has at most one mark per assessment, so a student's rows are few.
    """
    marks = db.marks.select("student_id", "assessment_id", "mark_obtained").where("mark_obtained IS NOT NULL")
    rows = gradable(marks.join(
        assessments_of(db, F.col("title").alias("assessment_title"), "type", "created_at", "max_mark", "course_id"),
        "assessment_id")).join(courses_of(db, "course_code", "course_name"), "course_id")
    in_order = Window.partitionBy("student_id").orderBy("created_at", "assessment_id")
    return rows.select(
        "student_id", "course_code", "course_name", "assessment_title", "type", "created_at",
        reported(score_percent(F.col("mark_obtained"), F.col("max_mark")), 2).alias("score_percent"),
        F.row_number().over(in_order).alias("position"))
