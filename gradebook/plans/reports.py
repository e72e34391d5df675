"""Reports assembled from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.functions.bands import letter_grade
from gradebook.functions.numbers import from_points, reported, to_points
from gradebook.functions.scores import score_rounded_item
from gradebook.operators import aggregates as agg
from gradebook.operators import rankings as rank
from gradebook.operators.facts import PAIR, course_facts
from gradebook.operators.joins import (
    assessments_of,
    assignment_grid,
    courses_of,
    courses_of_students,
    enrolled,
    mark_sheet,
    people,
    student_course_header,
)
from gradebook.sources.checkpoints import written_once
from gradebook.sources.tables import Gradebook

RANKING_PAGE = 1000


def _sorted_list(order: Column, *columns: str | Column) -> Column:
    """Structs of a bounded group as one array in the order of their first field."""
    return F.array_sort(F.collect_list(F.struct(order, *columns)))


# Lecturer


def lecturer_analytics(db: Gradebook) -> dict[str, DataFrame]:
    """The parts of the analytics page, each as a small DataFrame.

    Student totals feed three of them and are written once.
    """
    totals = written_once(agg.student_totals(db), "student_totals")
    return {
        "summary": _summary(db, totals),
        "pie": agg.students_by_course(db),
        "bar": agg.avg_completion_by_course(db),
        "line": agg.avg_final_by_course(db),
        "gpa": agg.avg_gpa_by_course(db),
        "top_students": rank.top_students_by_completion(db, totals=totals),
        "doughnut": agg.completion_brackets(db, totals),
    }


def lecturer_analytics_page(db: Gradebook) -> DataFrame:
    """The whole analytics page as one row: the summary, lists by course name, the best students and the brackets."""
    parts = lecturer_analytics(db)
    lists = [
        parts[name].agg(_sorted_list(F.col("course_name"), *[c for c in parts[name].columns if c != "course_name"]).alias(field))
        for name, field in (("pie", "pieData"), ("bar", "barData"), ("line", "lineData"), ("gpa", "gpaData"))]
    best = parts["top_students"].select((-F.col("total_completion")).alias("_order"), *parts["top_students"].columns)
    entries = F.array_sort(F.collect_list(F.struct(*best.columns)))
    top = best.agg(F.transform(entries, lambda x: x.dropFields("_order")).alias("topStudents"))
    brackets = parts["doughnut"].agg(_sorted_list(F.col("bracket"), "student_count").alias("doughnutData"))
    summary = parts["summary"].select(F.struct(*parts["summary"].columns).alias("summary"))
    return agg.one_row([summary, *lists, top, brackets])


def _summary(db: Gradebook, totals: DataFrame) -> DataFrame:
    return agg.one_row([
        agg.distinct_students(db),
        db.assessments.agg(F.count("*").alias("total_assessments")),
        db.remark_requests.agg(F.count("*").alias("total_remarks")),
        agg.average_completion(db, totals),
        agg.overall_averages(db),
    ])


def lecturer_analytics_summary(db: Gradebook) -> DataFrame:
    return _summary(db, agg.student_totals(db))


def mark_entry_sheet(db: Gradebook, pairs: DataFrame) -> DataFrame:
    """For requested (student_id, course_id) pairs: names, and every assessment with its mark, 0 if none."""
    marks = mark_sheet(db, zero_fill=True, pairs=pairs).groupBy(*PAIR).agg(
        _sorted_list("assessment_id", "title", "type", "max_mark", "weight", "mark_obtained").alias("marks"))
    return _or_empty(student_course_header(db, pairs, with_final=False).join(marks, PAIR, "left"), marks, "marks")


def final_exam_card(db: Gradebook, pairs: DataFrame) -> DataFrame:
    """For requested (student_id, course_id) pairs: names, final mark, GPA and the course's assessments."""
    lists = db.assessments.groupBy("course_id").agg(
        _sorted_list(F.col("id").alias("assessment_id"), "title", "type", "max_mark", "weight").alias("assessments"))
    cards = student_course_header(db, pairs).join(db.dim("assessments", lists), "course_id", "left")
    return _or_empty(cards, lists, "assessments")


def _or_empty(df: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


# Advisor


def advisee_report(db: Gradebook, ordered: bool = True) -> DataFrame:
    """Coursework per type, final mark, total and letter grade per (student, course).

    Courses of the same name and term stay apart.
    """
    points = to_points(F.coalesce("total_without_final", F.lit(0.0))) + F.coalesce(to_points(F.col("final")), F.lit(0))
    rows = (
        agg.type_pivot(db)
        .join(rank.final_for_mark_group(db).withColumnRenamed("final_mark", "final"), PAIR, "left")
        .join(courses_of(db, "course_name", "semester", "year"), "course_id")
        .join(people(db, F.col("name").alias("student_name"), "matric_number"), "student_id")
        .withColumn("total", from_points(points))
        .select(
            F.col("student_id").alias("user_id"), "student_name", F.col("matric_number").alias("student_id"),
            "course_id", "course_name", "semester", "year", "assignment", "quiz", "lab", "exercise", "midterm",
            "final", "total", letter_grade(F.col("total")).alias("status"))
    )
    if not ordered:
        return rows
    return rows.orderBy("student_name", F.desc("year"), F.desc("semester"), "course_name", "user_id", "course_id")


def advisor_dashboard(db: Gradebook) -> DataFrame:
    return agg.standing_counts(db)


def rankings_report(db: Gradebook, page_size: int = RANKING_PAGE) -> DataFrame:
    """Every course with its statistics and ranked students, in pages of ranks.

    A course with more students than ``page_size`` takes several rows; page 0
    holds the best. No row grows with the class, so a class of any size is built
    by many tasks. Courses without ranked students have one empty page.
    """
    ranked, stats = rank.ranked_with_stats(db)
    entry = ["rank", "student_id", "name"]
    pages = ranked.withColumn("page", F.floor((F.col("rank") - 1) / page_size)).groupBy("course_id", "page").agg(
        _sorted_list(*entry, reported(from_points(F.col("total_points")), 2).alias("total_mark")).alias("students"))
    header = ["course_id", "course_code", "course_name", "semester", "year", "total_students", "class_average"]
    filled = pages.join(db.dim("courses", stats), "course_id").select(*header, "page", "students")
    empty = stats.where("total_students = 0").select(
        *header, F.lit(0).cast("bigint").alias("page"),
        F.array().cast(filled.schema["students"].dataType).alias("students"))
    return filled.unionByName(empty).orderBy("course_code", "course_id", "page")


# Student


def my_marks(db: Gradebook) -> DataFrame:
    """Each enrolled course of each student with its assessments, final mark and total."""
    lists = _marked_assessments(db)
    return _or_empty(my_marks_totals(db).join(lists, PAIR, "left"), lists, "assessments")


def _marked_assessments(db: Gradebook) -> DataFrame:
    """Per enrolled pair the list of its course's assessments with the student's mark, if any.

    Only keys and marks are shuffled, once: a pair's marks meet its enrolment, and the course's assessments are
    added to the pair as one list, so the sheet of all pairs and assessments is never a table of its own.
    """
    course_of = assessments_of(db, "course_id").distinct()
    given = db.marks.select("student_id", "assessment_id", "mark_obtained").join(
        db.dim("assessments", course_of), "assessment_id").select(*PAIR, F.struct("assessment_id", "mark_obtained").alias("given"))
    stacked = enrolled(db).select(*PAIR, F.lit(1).alias("enrolment")).unionByName(given, allowMissingColumns=True)
    pairs = stacked.repartition(*PAIR).groupBy(*PAIR).agg(
        F.count("enrolment").alias("_times"), F.collect_list("given").alias("_given")).where("_times > 0")
    per_course = db.assessments.groupBy("course_id").agg(_sorted_list(
        F.col("id").alias("assessment_id"), "title", "type", "max_mark", "weight").alias("_items"))

    def entry(item: Column, mark: Column) -> Column:
        weighted = score_rounded_item(mark, item["max_mark"], item["weight"])
        return F.struct(
            item["assessment_id"].alias("assessment_id"), item["title"].alias("title"), item["type"].alias("type"), mark.alias("mark_obtained"),
            item["max_mark"].alias("max_mark"), item["weight"].alias("weight"), weighted.alias("weighted_mark"))

    def entries(item: Column) -> Column:
        marks = F.filter("_given", lambda given: given["assessment_id"] == item["assessment_id"])
        absent = F.lit(None).cast(db.marks.schema["mark_obtained"].dataType)
        return F.when(F.size(marks) == 0, F.array(entry(item, absent))).otherwise(F.transform(marks, lambda given: entry(item, given["mark_obtained"])))

    listed = F.flatten(F.transform("_items", entries))
    # A pair that is enrolled more than once has its list as often.
    repeated = F.when(F.col("_times") == 1, listed).otherwise(F.flatten(F.array_repeat(listed, F.col("_times").cast("int"))))
    return pairs.join(db.dim("assessments", per_course), "course_id").select(*PAIR, F.array_sort(repeated).alias("assessments"))


def my_marks_totals(db: Gradebook) -> DataFrame:
    """Total of the rounded weighted marks plus the final mark, per enrolled course."""
    total = F.coalesce("rounded_points", F.lit(0)) + F.coalesce(to_points(F.col("final_mark")), F.lit(0))
    return course_facts(db).join(courses_of(db, "course_code", "course_name"), "course_id").select(
        *PAIR, "course_code", "course_name", "final_mark",
        reported(from_points(total), 2).alias("total_weighted"))


def student_dashboard(db: Gradebook) -> DataFrame:
    """One card per student. Lists hold the newest or best rows, or the student's courses."""
    lists = {
        "recent_notifications": (rank.recent_notifications(db), ["position", "id", "title", "message", "created_at"]),
        "enrolled_courses": (courses_of_students(db), ["course_id", "course_code", "course_name", "semester", "year"]),
        "top_courses": (rank.top_courses_per_student(db), ["position", "course_id", "final_mark", "course_code", "course_name"]),
        "advisor_notes": (rank.recent_notes(db), ["position", "id", "note", "meeting_date"]),
        "assessment_status": (agg.assessment_completion(db), ["course_id", "course_code", "course_name", "total", "completed"]),
        "recent_remark_requests": (rank.recent_remarks(db), ["position", "id", "status", "assessment_title", "course_code"]),
    }
    mark = F.col("final_mark")
    counted = [
        enrolled(db).select("student_id", F.lit(1).alias("enrolment")),
        db.final_exams.select("student_id", "final_mark"),
        db.remark_requests.where("status = 'pending'").select("student_id", F.lit(1).alias("pending")),
    ]
    measures = [
        F.count("enrolment").alias("total_courses"),
        F.coalesce(agg.mean_of(mark, 2), F.lit(0.0)).alias("average_mark"),
        F.coalesce(F.max(mark).cast("double"), F.lit(0.0)).alias("highest_mark"),
        F.coalesce(F.min(mark).cast("double"), F.lit(0.0)).alias("lowest_mark"),
        F.count("pending").alias("pending_remarks"),
    ]
    names = db.users.where("role = 'student'").select(F.col("id").alias("student_id"), F.col("name").alias("student_name"))
    return _cards(names, counted, measures, lists)


def student_profile(db: Gradebook) -> DataFrame:
    """Each student's details, courses and average final mark, NULL without exams."""
    details = db.users.where("role = 'student'").select(
        F.col("id").alias("student_id"), "name", "email", "matric_number", "role")
    courses = (courses_of_students(db), ["course_id", "course_code", "course_name", "semester", "year"])
    return _cards(
        details, [db.final_exams.select("student_id", "final_mark")],
        [agg.mean_of(F.col("final_mark"), 4).alias("average_final_mark")], {"courses": courses})


def _cards(
    people_rows: DataFrame, counted: list[DataFrame], measures: list[Column],
    lists: dict[str, tuple[DataFrame, list[str]]],
) -> DataFrame:
    """Numbers and lists per student next to the student's own columns.

    All parts are stacked and reduced in one aggregation per student, instead of
    one join per part. Collecting lists saves nothing before a shuffle, so the rows
    go straight to their student's task; a student has few of them, at most some
    per course. Every student keeps a card through a marker row of their own.
    """
    owner = people_rows.select("student_id", F.struct(*people_rows.columns[1:]).alias("_owner"))
    entries = [rows.select("student_id", F.struct(*columns).alias(name)) for name, (rows, columns) in lists.items()]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [owner, *counted, *entries])
    cards = stacked.repartition("student_id").groupBy("student_id").agg(
        F.first("_owner", ignorenulls=True).alias("_owner"), *measures,
        *[F.array_sort(F.collect_list(name)).alias(name) for name in lists])
    return cards.where("_owner IS NOT NULL").select("student_id", "_owner.*", *cards.columns[2:])


def assignment_grid_nested(db: Gradebook) -> DataFrame:
    """One row per student of a course, with a flag per assessment of the course."""
    return assignment_grid(db).groupBy("course_id", "student_id", "name", "matric_number").agg(
        _sorted_list("assessment_id", "title", "type", "assigned").alias("assessments"))
