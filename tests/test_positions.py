"""Row numbers of groups that spread over many tasks."""

from books import assessment, book, course, enrolment, final, rows, student
from pyspark.sql import Window
from pyspark.sql import functions as F

from gradebook.operators import rankings
from gradebook.operators.keyed import top_per_key
from gradebook.operators.positions import number_within


def skewed(spark, n=20_000):
    """Two thirds of the rows in group 1, most of them with the same value."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 != 0, 1).otherwise(i % 7).alias("g"),
        F.when(i % 5 != 0, 0).otherwise(F.xxhash64(i) % 100).alias("v"), i.alias("k"))


def test_equals_the_window_function_on_a_hot_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = skewed(spark)
        numbered = number_within(frame, "g", [F.desc("v"), F.asc("k")], "n").cache()
        assert numbered.select(F.spark_partition_id().alias("p")).where("true").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = frame.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), "k")).cast("bigint"))
    assert numbered.exceptAll(expected).count() == 0 and numbered.count() == frame.count()


def test_a_hot_group_is_placed_by_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = skewed(spark).repartitionByRange(F.col("g"), F.desc("v"), F.asc("k")).where("g = 1").select(
            F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 3


def test_ranks_are_a_permutation_per_course(spark):
    users = [student(i) for i in range(1, 61)]
    db = book(spark, users=users, courses=[course(1), course(2), course(3)],
              course_user=[enrolment(i, 1) for i in range(1, 61)] + [enrolment(i, 2) for i in range(1, 61, 4)],
              assessments=[assessment(11, 1), assessment(21, 2)],
              final_exams=[final(1, i, i % 4) for i in range(1, 61)])
    ranked = rows(rankings.course_rankings(db), "course_id", "rank", "total_mark", "student_id")
    for course_id, size in ((1, 60), (2, 15)):
        inside = [r for r in ranked if r[0] == course_id]
        assert [r[1] for r in inside] == list(range(1, size + 1))
        assert [(-r[2], r[3]) for r in inside] == sorted((-r[2], r[3]) for r in inside)


def test_top_per_key_limits_before_the_shuffle(spark):
    plan = top_per_key(skewed(spark), "g", [F.desc("v"), F.asc("k")], 5)._jdf.queryExecution().executedPlan().toString()
    partial, shuffle = plan.rindex("WindowGroupLimit"), plan.rindex("Exchange hashpartitioning")
    assert plan.count("WindowGroupLimit") == 2 and partial > shuffle
