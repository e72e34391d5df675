"""Per-(student, course) facts, the common base of most reports.

Enrolments, marks, finals and rechecks are narrowed to (student, course, value)
rows, stacked, and reduced by one aggregation. Compared with left joins of
pre-aggregated tables this needs one shuffle and no sort, and partial
aggregation runs before it. Columns a report does not use are pruned by Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.functions.numbers import to_points
from gradebook.functions.scores import (
    score_completion,
    score_ratio,
    score_report,
    score_rounded_item,
)
from gradebook.operators.joins import assessments_of, enrolled
from gradebook.sources.tables import Gradebook

PAIR = ["student_id", "course_id"]


def scored_marks(db: Gradebook) -> DataFrame:
    """Marks with the assessment's columns and every score model in micro-points."""
    mark, top, weight = F.col("mark_obtained"), F.col("max_mark"), F.col("weight")
    return (
        db.marks.select("student_id", "assessment_id", "mark_obtained")
        .join(assessments_of(db, "course_id", "type", "max_mark", "weight"), "assessment_id")
        .select(
            *PAIR, "assessment_id", "type", "max_mark", "weight", "mark_obtained",
            to_points(score_ratio(mark, top, weight)).alias("ratio_points"),
            to_points(score_rounded_item(mark, top, weight)).alias("rounded_points"),
            to_points(score_completion(mark, top, weight)).alias("completion_points"),
            to_points(score_report(mark, weight)).alias("report_points"))
    )


def course_facts(
    db: Gradebook,
    *,
    role: str | None = "student",
    only_enrolled: bool = True,
    marks: bool = True,
    finals: bool = True,
    remarks: bool = False,
) -> DataFrame:
    """One row per (student, course).

    With ``only_enrolled`` the pairs are the enrolments (of ``role``, or of any
    role); otherwise every pair that has a mark, final or recheck.
    """
    parts, measures = [], []
    if only_enrolled:
        parts.append(enrolled(db, role).select(*PAIR, F.lit(1).alias("enrolment")))
        measures.append(F.count("enrolment").alias("enrolments"))
    if marks:
        parts.append(scored_marks(db).drop("assessment_id", "type", "max_mark").withColumn("mark_row", F.lit(1)))
        measures += [
            F.count("mark_row").alias("marks_count"),
            F.sum("mark_obtained").alias("mark_sum"),
            F.sum("weight").alias("marked_weight"),
            F.sum("ratio_points").alias("ratio_points"),
            F.sum("rounded_points").alias("rounded_points"),
            F.sum("completion_points").alias("completion_points"),
        ]
    if finals:
        parts.append(db.final_exams.select(*PAIR, "final_mark", "gpa"))
        measures += [F.max("final_mark").alias("final_mark"), F.max("gpa").alias("gpa")]
    if remarks:
        parts.append(
            db.remark_requests.select("student_id", "assessment_id")
            .join(assessments_of(db, "course_id"), "assessment_id")
            .select(*PAIR, F.lit(1).alias("remark_row")))
        measures.append(F.count("remark_row").alias("remark_count"))

    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    facts = stacked.groupBy(*PAIR).agg(*measures)
    return facts.where("enrolments > 0").drop("enrolments") if only_enrolled else facts


def course_assessments(db: Gradebook) -> DataFrame:
    """Per course with assessments: their number, weight sum and sum of distinct weights."""
    return db.assessments.groupBy("course_id").agg(
        F.count("id").alias("assessment_count"),
        F.sum("weight").alias("weight_sum"),
        F.sum_distinct(F.col("weight")).alias("distinct_weight_sum"))
