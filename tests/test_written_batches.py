"""Batches that several steps read are computed once."""

from books import batch, book, course, enrolment, final, rows, student
from pyspark.sql import functions as F

from gradebook.plans import maintenance as m


def test_enrolments_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(x):
        calls.add(1)
        return x

    db = book(spark, users=[student(s) for s in range(1, 4)], courses=[course(1)], course_user=[enrolment(1, 1)], final_exams=[final(1, 1, 50)])
    changes = batch(spark, "enrolments", [(1, None, 1, 1), (2, None, 2, 1), (3, None, 3, 1), (4, None, 3, 1)]).withColumn("student_id", counted("student_id"))
    enrolments, exams = m.enrol(db.course_user, db.final_exams, changes, "2024-05-05 10:00:00")
    once = calls.value
    assert rows(exams, "student_id") == [(1,), (2,), (3,)] and rows(enrolments, "user_id") == [(1,), (2,), (3,)]
    assert calls.value == once == 4
