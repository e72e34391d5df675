"""Stored sums after batches of changes equal what is computed anew from the changed tables."""

import pytest
from books import assessment, batch, book, course, enrolment, final, mark, rows, student
from pyspark.sql import functions as F

from gradebook.operators import aggregates as agg
from gradebook.plans import maintenance as m
from gradebook.plans.upkeep import SUMS, Upkeep
from gradebook.sources.versions import VersionedTable

TS = "2024-05-05 10:00:00"


@pytest.fixture
def db(spark):
    pairs = [(s, c) for s in range(1, 25) for c in range(1, 6) if (s + c) % 3]
    return book(
        spark, users=[student(s) for s in range(1, 31)], courses=[course(c, f"Course {c % 4}") for c in range(1, 7)],
        course_user=[enrolment(s, c) for s, c in pairs] + [enrolment(30, 1, "lecturer")],
        assessments=[assessment(10 * c + k, c, max_mark=50 if k else 100, weight=10 + 5 * k) for c in range(1, 6) for k in range(3)],
        marks=[mark(10 * c + k, s, None if (s * c + k) % 7 == 0 else (s * 13 + c * 7 + k) % 50) for s, c in pairs for k in range(3) if (s + k) % 4],
        final_exams=[final(c, s, (s * 37 + c * 11) % 101, [None, 1.0, 2.0, 3.5, 4.0][(s + c) % 5]) for s, c in pairs if s % 6])


def same(kept, db):
    assert rows(kept.student_totals(db)) == rows(agg.student_totals(db))
    assert rows(kept.cgpa_per_student()) == rows(agg.cgpa_per_student(db))
    assert rows(kept.completion_brackets()) == rows(agg.completion_brackets(db))
    assert rows(kept.cgpa_distribution()) == rows(agg.cgpa_distribution(db).na.fill(0))
    assert rows(kept.standing_counts()) == rows(agg.standing_counts(db).drop("total_advisees"))
    assert rows(kept.average_completion()) == rows(agg.average_completion(db))
    assert rows(kept.overall_averages()) == rows(agg.overall_averages(db))
    for name in ("avg_final_by_course", "avg_gpa_by_course", "avg_completion_by_course"):
        assert rows(getattr(kept, name)(db)) == rows(getattr(agg, name)(db)), name


def test_every_kind_of_batch(spark, db, tmp_path):
    kept = Upkeep.create(db, f"{tmp_path}/kept", rows_per_file=5)
    same(kept, db)
    marks = VersionedTable.create(db.marks, f"{tmp_path}/marks", m.MARK_KEY, rows_per_file=20)
    exams = VersionedTable.create(db.final_exams, f"{tmp_path}/exams", m.FINAL_KEY, rows_per_file=20)
    users = VersionedTable.create(db.course_user, f"{tmp_path}/users", ["id"], rows_per_file=20)
    before = {r._file for r in kept.students.manifest().collect()}

    changes = batch(spark, "marks", [(1, 11, 2, 40.0), (2, 12, 2, None), (3, 21, 24, 7.0), (4, 11, 2, 41.0), (5, 31, 29, 30.0)])
    marks.rewrite(changes, lambda rows_, ch: m.save_marks(rows_, ch, TS))
    kept.follow(db, {"marks": marks.difference(1, 2)})
    db = db.replace(marks=marks.read())
    same(kept, db)
    # Three students changed: the files of the others are those of the first version.
    assert len(before - {r._file for r in kept.students.manifest().collect()}) <= 3 < len(before)

    marks.delete(db.marks.where("student_id = 5 OR assessment_id = 41"))
    kept.follow(db, {"marks": marks.difference(2, 3)})
    db = db.replace(marks=marks.read())
    finals = batch(spark, "finals", [(1, 1, 1, 90.0, 25.0), (2, 2, 24, 20.0, None), (3, 5, 29, 66.0, 10.0), (4, 1, 3, None, 1.0)])
    exams.rewrite(finals, lambda rows_, ch: m.record_finals(db.replace(final_exams=rows_), ch, TS)[0])
    kept.follow(db, {"final_exams": exams.difference(1, 2)})
    db = db.replace(final_exams=exams.read())
    same(kept, db)

    gone = spark.createDataFrame([(102,), (205,), (2401,)], "id BIGINT")
    pairs = db.course_user.join(gone, "id").select(F.col("user_id").alias("student_id"), "course_id")
    users.delete(gone)
    exams.delete(pairs)
    kept.follow(db, {"course_user": users.difference(1, 2), "final_exams": exams.difference(2, 3)})
    db = db.replace(course_user=users.read(), final_exams=exams.read())
    same(kept, db)

    # Nothing changes: nothing is written.
    version = kept.students.commit().version
    marks.rewrite(db.marks.limit(1).select(F.lit(1).cast("bigint").alias("seq"), *m.MARK_KEY, "mark_obtained"), lambda rows_, ch: rows_)
    kept.follow(db, {"marks": marks.difference(3, 4)})
    assert kept.students.commit().version == version
    with pytest.raises(ValueError):
        kept.follow(db, {"users": (db.users, db.users)})


def test_of_nothing(spark, tmp_path):
    db = book(spark)
    kept = Upkeep.create(db, f"{tmp_path}/kept")
    assert kept.student_totals(db).count() == 0 and rows(kept.overall_averages()) == [(0.0, 0.0)]
    assert rows(kept.average_completion()) == [(0.0,)] and [r.student_count for r in kept.completion_brackets().collect()] == [0] * 4


def test_measures_walk_the_courses_once(spark, db):
    """The sums read numbers per student; none has the courses' array in it."""
    from gradebook.plans.upkeep import _by_measure

    students = spark.createDataFrame([], "student_id BIGINT, sign INT, courses ARRAY<STRUCT<course_id BIGINT, " + ", ".join(
        f"{c}: BIGINT" for c in SUMS) + ">>")
    plan = _by_measure(students)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lambda" in line for line in plan.splitlines() if "Aggregate" in line)
