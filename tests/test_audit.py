"""Broken keys and references on literal tables."""

import pytest
from books import T0, assessment, book, course, enrolment, final, mark, rows, student

from catalog.queries import tables
from gradebook.operators.audit import Key, Reference, key_audit


def test_every_rule(spark):
    db = book(
        spark, users=[student(1), student(2), student(2)], courses=[course(1)],
        course_user=[enrolment(1, 1), (500, 1, 1, "student"), enrolment(2, 9), (501, None, 1, "student")],
        assessments=[assessment(11, 1), assessment(12, None)], marks=[mark(11, 1, 5), mark(99, 1, 5), (7, 11, 3, 5, T0)],
        final_exams=[final(1, 1, 10), final(1, 1, 10, id=3)], advisor_notes=[(1, 1, 1, None, "a", T0), (2, 8, 1, 4, "a", T0)],
        notifications=[(1, None, "t", "m", 0, T0), (None, 1, "t", "m", 0, T0)])
    assert rows(key_audit(db)) == sorted([
        ("users", "id is repeated", 2, None, 2, 2),
        ("course_user", "user_id, course_id is repeated", 1, 1, 2, 101),
        ("course_user", "user_id is required", None, None, 1, 501),
        ("course_user", "course_id is not in courses", 9, None, 1, 209),
        ("assessments", "course_id is required", None, None, 1, 12),
        ("marks", "assessment_id is not in assessments", 99, None, 1, 1099),
        ("marks", "student_id is not in users", 3, None, 1, 7),
        ("final_exams", "course_id, student_id is repeated", 1, 1, 2, 3),
        ("advisor_notes", "advisor_id is not in users", 8, None, 1, 2),
        ("advisor_notes", "course_id is not in courses", 4, None, 1, 2),
        ("notifications", "user_id is required", None, None, 1, 1),
    ], key=lambda r: [(v is not None, v) for v in r])


def test_one_exchange(spark):
    text = key_audit(tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") - text.count("ReusedExchange") <= 1 + text.count("Exchange hashpartitioning(l_orderkey")
    assert "Join" not in text.split("HashAggregate", 1)[0]


def test_empty_tables_have_no_violations(spark):
    assert key_audit(book(spark)).count() == 0


def test_a_shuffled_row_is_as_wide_as_the_largest_space(spark):
    """Eight rules are about ids of users, more than about any other values; each has a count and a least id."""
    plan = key_audit(book(spark))._jdf.queryExecution().executedPlan().toString()
    partial = next(line for line in plan.splitlines() if "partial_count" in line)
    assert partial.count("partial_count") == 8 and partial.count("partial_min") == 8


def test_own_rules(spark):
    db = book(spark, users=[student(1), student(1), student(1)], marks=[mark(11, 1, 5), mark(11, 2, 5)])
    assert rows(key_audit(db, [Key("users", ("id",))], [Reference("marks", "student_id", "users")])) == [
        ("marks", "student_id is not in users", 2, None, 1, 2011), ("users", "id is repeated", 1, None, 3, 1)]
    with pytest.raises(ValueError):
        key_audit(db, [Key("users", ("id",))], [Reference("marks", "assessment_id", "assessments")])
