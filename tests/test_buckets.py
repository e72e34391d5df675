"""Listings without an exchange, and pages that stay in place."""

import random
from datetime import datetime
from uuid import uuid4

import pytest
from books import T0, book, course, enrolment, final, mark, rows, student
from pyspark.sql import functions as F

from gradebook.operators import joins
from gradebook.operators import rankings as rank
from gradebook.sources.buckets import load_by_person, page, store_by_person
from gradebook.sources.schema import TABLES


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    db = book(
        spark, users=[student(s) for s in range(1, 60)], courses=[course(c) for c in range(1, 5)],
        course_user=[enrolment(s, c) for s in range(1, 60) for c in range(1, 5) if (s + c) % 2],
        marks=[mark(10 * c, s, s) for s in range(1, 60) for c in range(1, 5)], final_exams=[final(c, s, s) for s in range(1, 60) for c in (1, 2)],
        notifications=[(i, i % 59 + 1, "t", "m", 0, T0) for i in range(200)])
    name = f"by_person_{uuid4().hex}"
    store_by_person(db, name, 4)
    yield db, load_by_person(spark, name)
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_the_tables_are_the_same(stored):
    db, bucketed = stored
    for name in TABLES:
        assert rows(getattr(bucketed, name)) == rows(getattr(db, name))


@pytest.mark.parametrize("listing", [
    lambda db: joins.course_roster(db, ordered=False), lambda db: joins.enrolled_students(db, ordered=False),
    lambda db: joins.final_exam_list(db, ordered=False), joins.enrolments, lambda db: rank.recent_notifications(db)])
def test_listings_need_no_exchange(spark, stored, listing):
    db, bucketed = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = listing(bucketed)
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text
        # The same listing over plain files moves the rows by person.
        assert rows(found) == rows(listing(db))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


ORDER = [("created_at", "desc"), ("title", "asc"), ("id", "asc")]


def listed(spark, values):
    return spark.createDataFrame(values, "id INT, title STRING, created_at TIMESTAMP_NTZ")


def read_all(frame_of, n):
    """All rows page by page; ``frame_of(k)`` is the table as it is when page k is read."""
    found, after = [], None
    for k in range(100):
        got = [r.asDict() for r in page(frame_of(k), ORDER, n, after).collect()]
        found += [r["id"] for r in got]
        if len(got) < n:
            return found
        after = got[-1]


def test_pages_hold_every_row_once_in_order(spark):
    r = random.Random(3)
    values = [(i, r.choice([None, "a", "b"]), r.choice([None, T0, datetime(2024, 2, 1), datetime(2024, 3, 1)])) for i in range(60)]
    whole = [x.id for x in listed(spark, values).orderBy(*[F.asc(c) if w == "asc" else F.desc(c) for c, w in ORDER]).collect()]
    assert read_all(lambda k: listed(spark, values), 7) == whole


def test_pages_stay_in_place_when_rows_are_added(spark):
    values = [(i, "t", datetime(2024, 1, 1 + i)) for i in range(20)]
    newer = [(100 + i, "t", datetime(2025, 1, 1 + i)) for i in range(3)]
    assert read_all(lambda k: listed(spark, values + newer if k else values), 6) == list(range(19, -1, -1))
    assert page(listed(spark, []), ORDER, 5).count() == 0
