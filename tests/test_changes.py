"""Batches of changes on literal tables, with the batch broadcast and shuffled."""

from datetime import datetime

import pytest
from books import T0, batch, book, course, enrolment, final, mark, rows, student
from pyspark.sql import functions as F

from gradebook.operators import changes, joins
from gradebook.operators.filters import required_fields, resolve_matric
from gradebook.plans import maintenance as m

TS = "2024-05-05 10:00:00"
NOW = datetime(2024, 5, 5, 10)


@pytest.fixture(params=["broadcast", "shuffled"])
def size(request, monkeypatch):
    """Runs a test on both sides of the broadcast bound."""
    if request.param == "shuffled":
        for module in (changes, joins):
            monkeypatch.setattr(module, "has_at_most", lambda df, n: False)
        monkeypatch.setattr(changes, "checked_broadcast", lambda df: df)


def test_upsert_last_change_wins_and_other_columns_stay(spark, size):
    db = book(spark, marks=[mark(11, 1, 5), mark(12, 1, 6)])
    ch = batch(spark, "marks", [(1, 11, 1, 7.0), (3, 11, 1, None), (2, 11, 1, 9.0), (4, 13, 1, 1.0), (5, 13, 1, 2.0)])
    out = m.save_marks(db.marks, ch, TS)
    assert rows(out, "assessment_id", "mark_obtained", "created_at") == [(11, None, T0), (12, 6.0, T0), (13, 2.0, NOW)]
    assert out.columns == db.marks.columns
    assert rows(out.where("assessment_id = 13"), "id") != [(None,)]
    again = m.save_marks(out, ch, TS)
    assert rows(again) == rows(out)


def test_upsert_sets_stamps_the_base_has(spark, size):
    base = book(spark, marks=[mark(11, 1, 5), mark(12, 1, 5)]).marks.withColumn("updated_at", F.lit(T0).cast("timestamp_ntz"))
    out = m.save_marks(base, batch(spark, "marks", [(1, 11, 1, 7.0), (2, 13, 1, 7.0)]), TS)
    assert rows(out, "assessment_id", "updated_at") == [(11, NOW), (12, T0), (13, NOW)]


def test_insert_ignore_keeps_existing_rows(spark, size):
    db = book(spark, marks=[mark(11, 1, 5)])
    out = m.assign_marks(db.marks, batch(spark, "marks", [(1, 11, 1), (2, 12, 1), (3, 12, 1)], "seq assessment_id student_id"), TS)
    assert rows(out, "assessment_id", "mark_obtained") == [(11, 5), (12, None)]


def test_insert_unique_rejects_repeats_blank_and_missing(spark, size):
    db = book(spark, remark_requests=[(1, 1, 11, "old", "approved", T0)])
    ch = batch(spark, "remarks", [
        (1, 1, 11, "x"), (2, 1, 12, " first "), (3, 1, 12, "second"), (4, 1, 13, " \t"), (5, 1, None, "x"), (6, 1, 14, "0")],
        "seq student_id assessment_id message")
    out, rejected = m.request_remarks(db.remark_requests, ch, TS)
    assert rows(out, "assessment_id", "message", "status") == [(11, "old", "approved"), (12, "first", "pending"), (14, "0", "pending")]
    assert rows(rejected, "seq", "reason") == [
        (1, "A request for this assessment exists."), (3, "A request for this assessment exists."),
        (4, "message is required"), (5, "assessment_id is required")]


def test_update_overwrites_with_null_and_ignores_unknown_ids(spark, size):
    db = book(spark, users=[student(1), student(2)])
    ch = batch(spark, "users", [(1, 1, "New", "e", None, None, "advisor"), (2, 9, "X", "e", None, None, "student")])
    out = changes.update(db.users, ch, "id", ["name", "email", "matric_number", "program", "role"])
    assert rows(out) == [(1, "New", "e", None, None, "advisor"), student(2)]
    role_only = changes.update(db.users, ch, "id", ["role"])
    assert rows(role_only, "name", "role") == [("S1", "advisor"), ("S2", "student")]


def test_delete_reports_per_key(spark, size):
    db = book(spark, advisor_notes=[(1, 9, 1, None, "a", T0), (2, 9, 1, None, "b", T0)])
    out, outcome = m.delete_notes(db.advisor_notes, spark.createDataFrame([(1,), (7,), (7,)], "id BIGINT"))
    assert rows(out, "id") == [(2,)]
    assert rows(outcome) == [(1, True), (7, False)]


def test_enrol_twice_changes_nothing_and_withdraw_restores(spark, size):
    db = book(spark, course_user=[enrolment(1, 1)], final_exams=[final(1, 1, 50, 2.0)])
    ch = batch(spark, "enrolments", [(1, 1, 1), (2, 2, 1), (3, 2, 1)], "seq student_id course_id")
    users, finals = m.enrol(db.course_user, db.final_exams, ch, TS)
    assert rows(users, "user_id", "course_id", "role") == [(1, 1, "student"), (2, 1, "student")]
    assert rows(finals, "student_id", "final_mark", "gpa") == [(1, 50, 2.0), (2, 0, None)]
    assert [rows(f) for f in m.enrol(users, finals, ch, TS)] == [rows(users), rows(finals)]
    added = users.where("user_id = 2").select("id").union(spark.createDataFrame([(999,)], "id BIGINT"))
    back = m.withdraw(users, finals, added)
    assert [rows(f) for f in back] == [rows(db.course_user), rows(db.final_exams)]


def test_move_uses_the_new_student_at_the_old_course(spark, size):
    db = book(spark, course_user=[enrolment(1, 1), enrolment(2, 1), enrolment(3, 3)],
              final_exams=[final(1, 1, 10), final(1, 2, 20), final(3, 3, 30)])
    ch = batch(spark, "enrolments", [(1, 101, 1, 2), (2, 303, 2, 3), (3, 777, 1, 1), (4, 201, 3, 2)])
    users, finals, rejected = m.move_enrolments(db.course_user, db.final_exams, ch)
    assert rows(users, "id", "user_id", "course_id") == [(101, 1, 2), (201, 3, 2), (303, 2, 3)]
    # 101 moved with its exam; 201 went to student 3, who has no exam at course 1; 303 kept its course.
    assert rows(finals, "student_id", "course_id", "final_mark") == [(1, 2, 10), (2, 1, 20), (3, 3, 30)]
    assert rows(rejected, "id", "reason") == [(777, "Enrollment not found.")]


def test_record_finals_checks_grades_and_notifies(spark, size):
    db = book(spark, courses=[course(1, "Maths")], assessments=[(11, 1, "a", "quiz", 100, 75, T0)], final_exams=[final(1, 1, 0)])
    ch = batch(spark, "finals", [(1, 1, 1, 80.0, 25.0), (2, 1, 2, 90.0, None), (3, 1, 1, 50.0, 20.0), (4, 2, 1, 85.0, None)])
    finals, notices, rejected = m.record_finals(db, ch, TS)
    assert rows(finals, "course_id", "student_id", "final_mark", "gpa") == [(1, 1, 50.0, 2.0), (2, 1, 85.0, 4.0)]
    assert rows(notices, "user_id", "message", "is_read") == [
        (1, "Your final exam mark for Course ID 2 has been recorded. GPA: 4", 0),
        (1, "Your final exam mark for Maths has been recorded. GPA: 2", 0),
        (1, "Your final exam mark for Maths has been recorded. GPA: 3.5", 0)]
    assert notices.select("id").distinct().count() == 3
    assert rows(rejected, "seq", "reason") == [(2, "Combined weight exceeds 100%. Current assessments weight: 75%.")]


def test_notes_by_id_and_by_matric(spark, size):
    db = book(spark, users=[student(1), (2, "T", "t@x", "A2", None, "lecturer")])
    by_id = batch(spark, "notes", [(1, 9, 1, "hi", None), (2, None, 1, "hi", T0), (3, 9, 1, "0", T0)],
                  "seq advisor_id student_id note meeting_date")
    notes, rejected = m.add_notes(db.advisor_notes, db.users, by_id, TS)
    assert rows(notes, "student_id", "note") == [(1, "hi")]
    assert rows(rejected, "seq", "reason") == [(2, "advisor_id is required"), (3, "note is required")]
    by_matric = batch(spark, "notes", [(1, 9, "A1", "hi", T0), (2, 9, "A2", "hi", T0), (3, 9, "A1", "hi", None)],
                      "seq advisor_id matric_number note meeting_date")
    notes, rejected = m.add_notes(db.advisor_notes, db.users, by_matric, TS, by_matric=True)
    assert rows(notes, "student_id", "note") == [(1, "hi")]
    assert rows(rejected, "seq", "reason") == [(2, "Student not found"), (3, "meeting_date is required")]


def test_add_users_and_courses(spark):
    db = book(spark)
    users, rejected = m.add_users(db.users, batch(spark, "users", [
        (1, None, "N", "n@x", None, None, "student"), (2, None, "N", "", None, None, "student")]), TS)
    assert rows(users, "name", "email") == [("N", "n@x")]
    assert rows(rejected, "seq", "reason") == [(2, "email is required")]
    added = m.add_courses(db.courses, batch(spark, "courses", [(1, None, "C1", "X", 1, 2024)]), TS)
    assert rows(added, "course_code", "created_at") == [("C1", NOW)]


def test_resolve_matric_with_and_without_role(spark):
    db = book(spark, users=[student(1), (2, "T", "t@x", "A2", None, "lecturer"), student(3, matric=None)])
    asked = spark.createDataFrame([("A1",), ("A2",), (None,)], "matric_number STRING")
    found, unknown = resolve_matric(asked, db.users)
    assert rows(found, "student_id") == [(1,)] and rows(unknown, "matric_number") == [(None,), ("A2",)]
    assert rows(resolve_matric(asked, db.users, students_only=False)[0], "student_id") == [(1,), (2,)]


def test_required_fields_names_the_first_missing_one(spark):
    frame = spark.createDataFrame([(1, "a", 5), (2, "", 0), (3, "b", None)], "seq BIGINT, note STRING, n BIGINT")
    complete, rejected = required_fields(frame, ["note", "n"])
    assert rows(complete, "seq") == [(1,)]
    assert rows(rejected, "seq", "reason") == [(2, "note is required"), (3, "n is required")]
