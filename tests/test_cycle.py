"""Tables that are loaded, changed, written and loaded again; batches with unusable lines; keys after moves."""

from datetime import datetime

import pytest
from books import T0, assessment, batch, book, course, enrolment, final, mark, rows, student
from pyspark.sql import functions as F

import gradebook
from catalog.batches import batch as derived
from catalog.queries import tables
from gradebook.operators import changes
from gradebook.plans import maintenance as m
from gradebook.sources.schema import BATCHES, TABLES
from gradebook.sources.sinks import write_table
from gradebook.sources.tables import read_changes

TS = "2024-05-05 10:00:00"
NOW = datetime(2024, 5, 5, 10)


@pytest.fixture
def stored(spark, tmp_path):
    """A stored book whose tables have columns of their own, one of them secret."""
    db = book(spark, users=[student(1), student(2)], courses=[course(1), course(2)], course_user=[enrolment(1, 1), enrolment(2, 1)],
              assessments=[assessment(11, 1, weight=20)], marks=[mark(11, 1, 5)], final_exams=[final(1, 1, 10), final(1, 2, 20)],
              advisor_notes=[(1, 9, 1, None, "a", T0)], remark_requests=[(1, 1, 11, "old", "approved", T0)])
    for name in TABLES:
        extra = getattr(db, name).withColumns({
            "created_by": F.lit(7).cast("bigint"), "updated_at": F.lit(T0).cast("timestamp_ntz"), "password": F.lit("x")})
        write_table(extra, f"{tmp_path}/v1/{name}")
    return gradebook.load(spark, f"{tmp_path}/v1")


def test_every_change_keeps_the_table(spark, stored, tmp_path):
    pairs = "seq student_id course_id"
    out = {
        "marks": m.save_marks(stored.marks, batch(spark, "marks", [(1, 11, 1, 8.0), (2, 11, 2, 9.0)]), TS),
        "remark_requests": m.save_remarks(stored.remark_requests, batch(spark, "remarks", [(1, 1, 11, "x", "pending"), (2, 2, 11, "y", "pending")]), TS),
        "assessments": m.save_assessments(stored.assessments, batch(
            spark, "assessments", [(1, 11, 1, "t", "quiz", 100, 25, None), (2, None, 1, "n", "lab", 50, 5, 42)]), TS)[0],
        "courses": m.add_courses(stored.courses, batch(spark, "courses", [(1, None, "C9", "X", 1, 2024)]), TS),
        "users": m.add_users(stored.users, batch(spark, "users", [(1, None, "N", "n@x", None, None, "student")]), TS)[0],
        "advisor_notes": m.add_notes(stored.advisor_notes, stored.users, batch(
            spark, "notes", [(1, 9, 1, "hi", None)], "seq advisor_id student_id note meeting_date"), TS)[0],
        "course_user": m.enrol(stored.course_user, stored.final_exams, batch(spark, "enrolments", [(1, 2, 2)], pairs), TS)[0],
        "final_exams": m.record_finals(stored, batch(spark, "finals", [(1, 1, 1, 80.0, 25.0)]), TS)[0],
        "notifications": m.record_finals(stored, batch(spark, "finals", [(1, 1, 1, 80.0, 25.0)]), TS)[1],
    }
    for name in TABLES:
        write_table(out[name], f"{tmp_path}/v2/{name}")
    again = gradebook.load(spark, f"{tmp_path}/v2")
    for name in TABLES:
        assert getattr(again, name).dtypes == getattr(stored, name).dtypes and "password" not in getattr(again, name).columns
    assert rows(again.marks, "student_id", "mark_obtained", "created_by", "updated_at") == [(1, 8, 7, NOW), (2, 9, None, NOW)]
    assert rows(again.assessments, "title", "weight", "created_by", "updated_at") == [("n", 5, 42, NOW), ("t", 25, 7, NOW)]
    moved, _, _ = m.move_enrolments(stored.course_user, stored.final_exams, batch(spark, "enrolments", [(1, 101, 1, 2)]), TS)
    assert rows(moved, "id", "course_id", "updated_at") == [(101, 2, NOW), (201, 1, T0)]


def test_a_value_that_does_not_fit_is_left_out_and_reported(spark, stored):
    changes_ = batch(spark, "marks", [(1, 11, 1, 8.5), (2, 11, 2, 7.0), (3, 12, 1, 1e30)])
    assert rows(m.save_marks(stored.marks, changes_, TS), "student_id", "mark_obtained") == [(1, 5), (2, 7)]
    assert rows(m.rejected_changes(changes_, "marks", stored.marks), "seq", "reason") == [
        (1, "mark_obtained cannot hold 8.5"), (3, "mark_obtained cannot hold 1.0E30")]
    finals = batch(spark, "finals", [(1, 1, 1, 80.5, 25.0), (2, 1, 2, 60.0, 25.0)])
    out, notices, rejected = m.record_finals(stored, finals, TS)
    assert rows(out, "student_id", "final_mark") == [(1, 10), (2, 60)] and rows(notices, "user_id") == [(2,)]
    assert rows(rejected, "seq", "reason") == [(1, "final_mark cannot hold 80.5")]


def test_a_table_of_fractions_takes_them(spark, stored):
    fractions = stored.marks.withColumn("mark_obtained", F.col("mark_obtained").cast("double"))
    assert rows(m.save_marks(fractions, batch(spark, "marks", [(1, 11, 1, 8.5)]), TS), "mark_obtained") == [(8.5,)]


def test_bad_fields_are_reported_and_the_rest_is_applied(spark, stored, tmp_path):
    file = tmp_path / "fields.json"
    file.write_text(
        '{"seq": 1, "assessment_id": 11, "student_id": 1, "mark_obtained": "abc"}\n{"seq": 2, "assessment_id": 1.5, "student_id": 1}\n'
        '{"seq": 3, "assessment_id": 11, "student_id": 2, "mark_obtained": "9"}\n{"seq": 4, "assessment_id": 11, "student_id": 3, "mark_obtained": 72.5}\n'
        '{"seq": 5, "student_id": 3, "mark_obtained": 72}\n')
    read = read_changes(spark, str(file), BATCHES["marks"])
    assert rows(m.rejected_changes(read, "marks", stored.marks), "seq", "reason") == [
        (1, 'mark_obtained needs a number: "abc"'), (2, "assessment_id needs a whole number: 1.5"), (4, "mark_obtained cannot hold 72.5"),
        (5, "assessment_id is required")]
    assert rows(m.save_marks(stored.marks, read, TS), "student_id", "mark_obtained") == [(1, 5), (2, 9)]


def test_unusable_lines_never_reach_a_table(spark, stored, tmp_path):
    file = tmp_path / "changes.json"
    file.write_text(
        '{"seq": 1, "assessment_id": 11, "student_id": 1, "mark_obtained": 7}\n{broken\n{"seq": 2, "assessment_id": 11, "mark_obtained": 7}\n'
        '{"assessment_id": 11, "student_id": 2}\n{"seq": 3, "assessment_id": 12, "student_id": 2}\n{"seq": 3, "assessment_id": 13, "student_id": 2}\n')
    read = read_changes(spark, str(file), BATCHES["marks"])
    assert rows(m.rejected_changes(read, "marks"), "seq", "reason") == [
        (None, "Line cannot be read."), (None, "seq is required"), (2, "student_id is required"), (3, "seq is repeated."), (3, "seq is repeated.")]
    assert rows(m.save_marks(stored.marks, read, TS), "assessment_id", "student_id", "mark_obtained") == [(11, 1, 7)]
    assert rows(m.assign_marks(stored.marks, read, TS), "assessment_id", "student_id") == [(11, 1)]


def test_one_key_is_inserted_once(spark, stored):
    ch = batch(spark, "remarks", [(1, 2, 12, "a"), (1, 2, 12, "b"), (None, 2, 13, "c"), (4, None, 14, "d")], "seq student_id assessment_id message")
    added, rejected = m.request_remarks(stored.remark_requests, ch, TS)
    assert rows(added, "id") == [(1,)] and sorted(r.reason for r in rejected.collect()) == [
        "seq is repeated.", "seq is repeated.", "seq is required", "student_id is required"]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_keys_stay_unique_after_moves(spark, scale):
    db = tables(spark, f"/root/testdata/{scale}")
    before = [db.course_user.groupBy("user_id", "course_id").count().where("count > 1").count(),
              db.final_exams.groupBy("student_id", "course_id").count().where("count > 1").count()]
    users, finals, rejected = m.move_enrolments(db.course_user, db.final_exams, derived(db, "move_batch"))
    after = [users.groupBy("user_id", "course_id").count().where("count > 1").count(),
             finals.groupBy("student_id", "course_id").count().where("count > 1").count()]
    assert before == after == [0, 0] and rejected.where("reason <> 'Enrollment not found.'").count() > 0


def test_stored_as_leaves_equal_types_alone(spark):
    assert changes.append(spark.range(1), spark.range(1)).count() == 2
