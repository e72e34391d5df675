"""The nine tables derived from a TPC-H-like star schema by the rules of FIXTURES.md.

Marks, enrolments and final exams all come from the same three-way join of line
items. It is reduced once to one row per student, course and line number, and
that summary is written when a query first needs it; marks are a projection of
it. Users, notifications and notes are plain views over the Parquet files.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.functions.bands import gpa_from_mark
from gradebook.sources.checkpoints import written_once
from gradebook.sources.tables import Gradebook

STAFF_ID_BASE = 1_000_000_000


def derive(spark: SparkSession, directory: str) -> Gradebook:
    def raw(name: str) -> DataFrame:
        return spark.read.parquet(f"{directory}/{name}.parquet")

    @cache
    def summary() -> DataFrame:
        return written_once(_line_summary(raw("lineitem"), raw("orders"), raw("part")), "line_summary")

    @cache
    def courses() -> DataFrame:
        return written_once(_courses(raw("part")), "courses")

    return Gradebook(
        users=_users(raw("customer"), raw("supplier")),
        courses=courses,
        course_user=lambda: written_once(_course_user(summary(), raw("supplier")), "course_user"),
        assessments=lambda: written_once(_assessments(courses(), raw("lineitem")), "assessments"),
        marks=lambda: _marks(summary()),
        final_exams=lambda: written_once(_final_exams(summary()), "final_exams"),
        remark_requests=lambda: _remark_requests(_marks(summary())),
        notifications=_notifications(raw("events")),
        advisor_notes=_advisor_notes(raw("orders")),
    )


def _brand_number(brand: Column) -> Column:
    return F.substring(brand, 7, 20).cast("bigint")


def _line_summary(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    owners = orders.where("o_custkey % 40 <> 39").select(
        "o_orderkey", (F.col("o_custkey") + 1).alias("student_id"))
    brands = part.select("p_partkey", _brand_number(F.col("p_brand")).alias("course_id"))
    scored = F.when(F.col("l_returnflag") != "A", F.col("l_quantity").cast("bigint") * (1 + F.col("l_linenumber") % 2))
    # Narrowed before the joins, and parts first, so that each shuffle carries the fewest columns. A pair's lines
    # are brought to one task and written beside each other, so that later sums per pair combine before their shuffle.
    lines = lineitem.select(
        "l_orderkey", "l_partkey", F.col("l_linenumber").alias("k"), scored.alias("scored"), "l_shipdate",
        (F.col("l_partkey") * 13 + F.col("l_suppkey") * 7).alias("mix"))
    return (
        lines
        .join(brands, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
        .join(owners, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
        .repartition("student_id", "course_id")
        .groupBy("student_id", "course_id", "k")
        .agg(F.max("scored").alias("mark_obtained"), F.min("l_shipdate").alias("created_at"), F.sum("mix").alias("mix"))
        .sortWithinPartitions("student_id", "course_id", "k")
    )


def _courses(part: DataFrame) -> DataFrame:
    i = F.col("id")
    return part.select(_brand_number(F.col("p_brand")).alias("id")).distinct().select(
        "id",
        F.concat(F.lit("C"), F.lpad(i.cast("string"), 3, "0")).alias("course_code"),
        F.concat(F.lit("Course "), ((i - 1) % 20 + 1).cast("string")).alias("course_name"),
        (i % 2 + 1).cast("int").alias("semester"),
        (2022 + i % 3).cast("int").alias("year"),
        F.date_add(F.lit("2021-01-01").cast("date"), i.cast("int")).cast("timestamp_ntz").alias("created_at"),
    )


def _users(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    text = F.lit(None).cast("string")
    students = customer.select(
        (key + 1).alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        F.when(key % 50 != 7, F.concat(F.lit("A"), F.lpad((key + 1).cast("string"), 7, "0"))).alias("matric_number"),
        F.col("c_mktsegment").alias("program"), F.lit("student").alias("role"))
    staff = supplier.select(
        (F.col("s_suppkey") + STAFF_ID_BASE).alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email"),
        text.alias("matric_number"), text.alias("program"),
        F.when(F.col("s_suppkey") % 10 == 0, "advisor").otherwise("lecturer").alias("role"))
    return students.unionByName(staff)


def _course_user(summary: DataFrame, supplier: DataFrame) -> DataFrame:
    students = summary.select("student_id", "course_id").distinct().select(
        (F.col("student_id") * 100 + F.col("course_id")).alias("id"),
        F.col("student_id").alias("user_id"), "course_id", F.lit("student").alias("role"))
    teacher = F.col("s_suppkey") + STAFF_ID_BASE
    course = F.col("s_suppkey") % 25 + 1
    staff = supplier.select(
        (teacher * 100 + course).alias("id"), teacher.alias("user_id"),
        course.alias("course_id"), F.lit("lecturer").alias("role"))
    return students.unionByName(staff)


def _assessments(courses: DataFrame, lineitem: DataFrame) -> DataFrame:
    # The distinct line numbers are one small array, exploded per course.
    numbers = lineitem.agg(F.collect_set("l_linenumber")).scalar()
    k, course = F.col("k"), F.col("id")
    kinds = F.create_map(*[F.lit(v) for pair in (
        (1, "quiz"), (2, "assignment"), (3, "lab"), (4, "exercise"), (5, "test"), (6, "quiz")) for v in pair])
    return courses.where("id <> 25").select("id", "created_at", F.explode(numbers).alias("k")).select(
        (course * 10 + k).alias("id"), course.alias("course_id"),
        F.concat(F.lit("Assessment "), k.cast("string")).alias("title"),
        F.coalesce(F.try_element_at(kinds, k), F.lit("final")).alias("type"),
        (50 * (1 + k % 2)).cast("int").alias("max_mark"),
        F.when(k.isin(1, 7), 5).when(k.isin(2, 4, 5), 10)
        .when((course % 10 == 0) & (k == 3), 20).otherwise(15).cast("int").alias("weight"),
        "created_at")


def _marks(summary: DataFrame) -> DataFrame:
    # Course and number both come from the same rows as the assessments, so every
    # line outside course 25 has its assessment and no join is needed.
    assessment = F.col("course_id") * 10 + F.col("k")
    return summary.where("course_id <> 25").select(
        (F.col("student_id") * 1000 + assessment).alias("id"), assessment.alias("assessment_id"),
        "student_id", "mark_obtained", "created_at")


def _final_exams(summary: DataFrame) -> DataFrame:
    placeholder = (F.col("student_id") + F.col("course_id")) % 5 == 0
    return (
        summary.where("(student_id + course_id) % 7 <> 0")
        .groupBy("student_id", "course_id").agg(F.sum("mix").alias("mix"))
        .select((F.col("student_id") * 100 + F.col("course_id")).alias("id"), "course_id", "student_id",
                F.when(placeholder, F.lit(0)).otherwise(F.col("student_id") * 37 % 71 + F.col("mix") % 31)
                .cast("bigint").alias("final_mark"))
        .withColumn("gpa", F.when(~placeholder, gpa_from_mark(F.col("final_mark"))))
    )


def _remark_requests(marks: DataFrame) -> DataFrame:
    return marks.where("id % 11 = 0").select(
        "id", "student_id", "assessment_id",
        F.concat(F.lit("recheck "), F.col("id").cast("string")).alias("message"),
        F.when(F.col("id") % 3 == 0, "pending").when(F.col("id") % 3 == 1, "approved")
        .otherwise("rejected").alias("status"),
        "created_at")


def _notifications(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("event_id") + 1).alias("id"), (F.col("user_id") + 1).alias("user_id"),
        F.col("event_type").alias("title"), F.col("props").alias("message"),
        F.when(F.col("value") < 20, 1).otherwise(0).alias("is_read"), F.col("ts").alias("created_at"))


def _advisor_notes(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.where("o_orderstatus = 'P'").select(
        (key + 1).alias("id"), (STAFF_ID_BASE + key % 10 * 10).alias("advisor_id"),
        (F.col("o_custkey") + 1).alias("student_id"),
        F.when(key % 3 != 0, key % 25 + 1).alias("course_id"),
        F.col("o_orderpriority").alias("note"), F.col("o_orderdate").alias("meeting_date"))
