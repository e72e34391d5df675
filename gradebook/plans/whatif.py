"""Hypothetical marks laid over the stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.functions.numbers import from_points, reported, to_points
from gradebook.functions.scores import is_gradable, score_ratio
from gradebook.operators.joins import assessments_of
from gradebook.sources.checkpoints import written_once
from gradebook.sources.tables import Gradebook

ITEM_KEY = ["scenario_id", "student_id", "assessment_id"]
#: Rows that one task joins or reduces.
ROWS_PER_TASK = 250_000


def what_if_items(db: Gradebook, scenarios: DataFrame) -> DataFrame:
    """Every mark of a scenario's students, the supposed one where there is one.

    Stored and supposed marks are stacked and reduced per item, so both meet in
    one shuffle. Rows are counted first and dealt over as many tasks as they need, so the memory of a task does not
    grow with the tables. ``weighted_points`` is unrounded and ``weighted_mark`` for display.
    """
    students = written_once(scenarios.select("scenario_id", "student_id").distinct(), "students")
    mark = F.col("mark_obtained").cast("double").alias("mark")
    marks = db.marks.select("student_id", "assessment_id", mark)
    stored_rows, pairs = marks.count(), students.count()
    # A student's marks are repeated per scenario.
    scenarios_each = -(-pairs // max(1, students.select("student_id").distinct().count()))
    tasks = -(-max(1, stored_rows) // ROWS_PER_TASK)
    item_tasks = -(-max(1, stored_rows * scenarios_each + scenarios.count()) // ROWS_PER_TASK)
    stored = marks.repartition(tasks, "student_id").join(students.repartition(tasks, "student_id"), "student_id").withColumn(
        "supposed", F.lit(0))
    supposed = scenarios.select(*ITEM_KEY, mark).withColumn("supposed", F.lit(1))
    items = stored.select(*supposed.columns).unionByName(supposed).repartition(item_tasks, *ITEM_KEY).groupBy(*ITEM_KEY).agg(
        F.max(F.when(F.col("supposed") == 1, F.col("mark"))).alias("new_mark"),
        F.max(F.when(F.col("supposed") == 0, F.col("mark"))).alias("old_mark"))
    scored = items.withColumn("mark_obtained", F.coalesce("new_mark", "old_mark")).join(
        assessments_of(db, "course_id", "title", "max_mark", "weight"), "assessment_id")
    mark, top, weight = F.col("mark_obtained"), F.col("max_mark"), F.col("weight")
    points = F.when(is_gradable(mark, top, weight), to_points(score_ratio(mark, top, weight)))
    return scored.withColumn("weighted_points", points).select(
        *ITEM_KEY, "course_id", "title", "max_mark", "mark_obtained", "weight", "weighted_points",
        reported(from_points(F.col("weighted_points")), 2).alias("weighted_mark"))


def what_if_totals(db: Gradebook, scenarios: DataFrame) -> DataFrame:
    """Total per (scenario, student, course) from unrounded items, rounded once."""
    return what_if_items(db, scenarios).groupBy("scenario_id", "student_id", "course_id").agg(
        reported(from_points(F.coalesce(F.sum("weighted_points"), F.lit(0))), 2).alias("total"))
