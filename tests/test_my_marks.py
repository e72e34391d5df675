"""The list of a student's marks is made without a shuffled sheet of all pairs and assessments."""

from books import assessment, book, course, enrolment, mark, rows

from gradebook.plans import reports


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_my_marks_shuffles_keys_and_marks_only(spark):
    db = book(
        spark, courses=[course(1), course(2)], assessments=[assessment(11, 1), assessment(12, 1, weight=20), assessment(11, 2)],
        course_user=[enrolment(5, 1), enrolment(5, 1), enrolment(6, 1), enrolment(6, 2), enrolment(7, 2)],
        marks=[mark(11, 5, 50), mark(11, 6, 40), mark(11, 6, 60), mark(12, 9, 1)])
    found = reports.my_marks(db).selectExpr("student_id", "course_id", "transform(assessments, a -> (a.assessment_id, a.mark_obtained, a.weighted_mark)) AS list")
    assert [(s, c, [tuple(x) for x in items]) for s, c, items in rows(found)] == [
        (5, 1, [(11, 50, 5.0), (11, 50, 5.0), (12, None, None), (12, None, None)]),
        (6, 1, [(11, 40, 4.0), (11, 60, 6.0), (12, None, None)]),
        (6, 2, [(11, 40, 4.0), (11, 60, 6.0)]),
        (7, 2, [(11, None, None)]),
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(reports.my_marks(db))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # No join by student and assessment: everything that is shuffled by student goes by pair.
    shuffled = [line for line in text.splitlines() if "hashpartitioning(student_id" in line]
    assert shuffled and not any("assessment_id" in line.split("hashpartitioning")[1].split(")")[0] for line in shuffled)
