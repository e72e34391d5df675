"""The what-if items are dealt over as many tasks as their rows need."""

import re

from books import assessment, book, course, mark, rows

from gradebook.plans import whatif


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_if_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(whatif, "ROWS_PER_TASK", 4)
    db = book(spark, courses=[course(1)], assessments=[assessment(11, 1), assessment(12, 1)], marks=[mark(a, s, 50) for a in (11, 12) for s in range(1, 11)])
    supposed = spark.createDataFrame([(c, s, 11, 80.0) for c in (1, 2) for s in range(1, 6)], "scenario_id bigint, student_id bigint, assessment_id bigint, mark_obtained double")
    items = whatif.what_if_items(db, supposed)
    assert rows(items, "scenario_id", "student_id", "assessment_id", "mark_obtained") == sorted(
        [(c, s, 11, 80.0) for c in (1, 2) for s in range(1, 6)] + [(c, s, 12, 50.0) for c in (1, 2) for s in range(1, 6)])
    # 20 marks by student; 2 scenarios of 20 marks and 10 supposed ones by item.
    assert re.search(r"hashpartitioning\(student_id#\d+L, 5\)", plan(items))
    assert re.search(r"hashpartitioning\(scenario_id#\d+L, student_id#\d+L, assessment_id#\d+L, 13\)", plan(items))
