"""Edge cases the generated data lacks, on literal tables."""

from datetime import datetime

from books import T0, assessment, book, course, enrolment, final, mark, rows, student
from pyspark.sql import functions as F

from gradebook.functions.bands import gpa_from_mark, letter_grade, standing
from gradebook.functions.numbers import reported
from gradebook.functions.scores import score_ratio
from gradebook.functions.text import clean_text, exam_notice, is_missing
from gradebook.operators import aggregates as agg
from gradebook.operators import facts, filters, joins, keyed, quality
from gradebook.operators import rankings as rank
from gradebook.plans import reports, whatif


def column(spark, values, kind, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_gpa_bands(spark):
    marks = [85.0, 84.99, 75.0, 65.0, 55.0, 45.0, 35.0, 34.99, 0.0, None]
    assert column(spark, marks, "DOUBLE", gpa_from_mark) == [4.0, 3.5, 3.5, 3.0, 2.5, 2.0, 1.5, 1.0, 1.0, 1.0]


def test_letter_bands(spark):
    totals = [90.0, 80.0, 75.0, 70.0, 65.0, 60.0, 55.0, 50.0, 45.0, 44.99]
    assert column(spark, totals, "DOUBLE", letter_grade) == ["A+", "A", "A-", "B+", "B", "B-", "C+", "C", "D", "F"]


def test_standing_bands(spark):
    assert column(spark, [3.0, 2.999, 2.0, 1.999, None], "DOUBLE", standing) == [
        "Good Standing", "Warning", "Warning", "Probation", "Probation"]


def test_rounding_is_half_away_from_zero(spark):
    values = [1.005, 3.335, 2.5, -1.005]
    assert column(spark, values, "DOUBLE", lambda v: reported(v, 2)) == [1.01, 3.34, 2.5, -1.01]


def test_texts(spark):
    assert column(spark, [" a \t\n\r\0\x0b", " b"], "STRING", clean_text) == ["a", " b"]
    assert column(spark, ["", "0", None, " ", "0.0"], "STRING", is_missing) == [True, True, True, False, False]
    assert column(spark, [0, 1], "BIGINT", is_missing) == [True, False]
    notice = lambda g: exam_notice(F.lit(None).cast("string"), F.lit(7), g)
    assert column(spark, [4.0, 3.5], "DOUBLE", notice) == [
        "Your final exam mark for Course ID 7 has been recorded. GPA: 4",
        "Your final exam mark for Course ID 7 has been recorded. GPA: 3.5"]


def test_zero_max_mark_is_null_not_an_error(spark):
    db = book(spark, users=[student(1)], courses=[course(1)], course_user=[enrolment(1, 1)],
              assessments=[assessment(11, 1, max_mark=0), assessment(12, 1, max_mark=100, weight=20)],
              marks=[mark(11, 1, 5), mark(12, 1, 50)])
    assert column(spark, [5], "INT", lambda v: score_ratio(v, F.lit(0), F.lit(10))) == [None]
    assert rows(facts.scored_marks(db), "assessment_id", "ratio_points") == [(11, None), (12, 10_000_000)]
    assert rows(reports.my_marks_totals(db), "total_weighted") == [(10.0,)]
    assert rows(rank.performance_trend(db), "assessment_title", "score_percent", "position") == [("A12", 50.0, 1)]


def test_cgpa_just_below_two_is_probation_but_not_at_risk(spark):
    db = book(spark, users=[student(1), student(2)],
              final_exams=[final(1, 1, 50, 1.99), final(2, 1, 50, 2.002), final(1, 2, 0, None)])
    assert rows(rank.at_risk_students(db)) == []
    assert rows(agg.standing_counts(db), "total_advisees", "good_standing", "warning", "probation", "avg_cgpa") == [
        (2, 0, 0, 1, 2.0)]
    assert rows(rank.advisee_list(db), "user_id", "cgpa", "status") == [(1, 2.0, "Probation"), (2, 0.0, "Probation")]
    assert rows(agg.cgpa_distribution(db)) == [(0, 0, 0, 1)]
    assert rows(rank.top_students_by_cgpa(db), "student_id") == [(1,)]


def test_brackets_have_inclusive_upper_edges_and_are_always_four(spark):
    totals = spark.createDataFrame([(v,) for v in (25.0, 25.01, 50.0, 75.0, 75.01)], "total_completion DOUBLE")
    db = book(spark)
    assert rows(agg.completion_brackets(db, totals)) == [("0-25%", 1), ("26-50%", 2), ("51-75%", 1), ("76-100%", 1)]
    assert rows(agg.completion_brackets(db)) == [("0-25%", 0), ("26-50%", 0), ("51-75%", 0), ("76-100%", 0)]
    assert rows(agg.average_completion(db)) == [(0.0,)]


def test_empty_tables_give_zero_averages(spark):
    db = book(spark, courses=[course(1)])
    assert rows(agg.overall_averages(db)) == [(0.0, 0.0)]
    assert rows(agg.avg_final_by_course(db)) == [("Course 1", 0.0)]
    assert rows(agg.avg_completion_by_course(db)) == [("Course 1", 0.0)]
    assert rows(agg.avg_cgpa_by_course(db)) == []
    assert rows(agg.weights_per_course(db)) == [(1, 0)]


def test_ties_get_different_ranks_lower_id_first_and_empty_courses_stay(spark):
    db = book(spark, users=[student(1), student(2), student(3)], courses=[course(1), course(2)],
              course_user=[enrolment(2, 1), enrolment(1, 1), enrolment(3, 2), enrolment(3, 1, "lecturer")],
              assessments=[assessment(11, 1)], marks=[mark(11, 1, 80), mark(11, 2, 80)])
    assert rows(rank.course_rankings(db), "course_id", "student_id", "total_mark", "rank") == [(1, 1, 8.0, 1), (1, 2, 8.0, 2)]
    assert rows(rank.class_stats(db), "course_id", "total_students", "class_average") == [(1, 2, 8.0), (2, 0, 0.0)]
    assert rows(rank.rank_card(db), "student_id", "course_id", "your_rank", "total_students") == [
        (1, 1, 1, 2), (2, 1, 2, 2), (3, 2, None, 0)]
    pages = reports.rankings_report(db, page_size=1).collect()
    assert [(p.course_id, p.page, [s.student_id for s in p.students]) for p in pages] == [(1, 0, [1]), (1, 1, [2]), (2, 0, [])]


def test_items_are_rounded_before_or_after_the_sum(spark):
    db = book(spark, users=[student(1)], courses=[course(1)], course_user=[enrolment(1, 1)],
              assessments=[assessment(i, 1, max_mark=1000, weight=5) for i in (11, 12, 13)],
              marks=[mark(i, 1, 667) for i in (11, 12, 13)])
    assert rows(reports.my_marks_totals(db), "total_weighted") == [(10.02,)]
    scenario = spark.createDataFrame([(1, 1, 11, 667.0)], "scenario_id BIGINT, student_id BIGINT, assessment_id BIGINT, mark_obtained DOUBLE")
    assert rows(whatif.what_if_totals(db, scenario), "total") == [(10.01,)]
    assert rows(whatif.what_if_items(db, scenario), "weighted_mark") == [(3.34,), (3.34,), (3.34,)]


def test_the_two_progress_weights_differ(spark):
    db = book(spark, users=[student(1)], courses=[course(1)], course_user=[enrolment(1, 1)],
              assessments=[assessment(11, 1, weight=10), assessment(12, 1, weight=10), assessment(13, 1, weight=15)],
              marks=[mark(11, 1, None)], final_exams=[final(1, 1, 0)],
              remark_requests=[(1, 1, 11, "m", "pending", T0)])
    shown = ("assessment_count", "marks_count", "total_marks", "remark_count", "total_weight_completed")
    assert rows(agg.progress_lecturer(db), *shown) == [(3, 1, 0, 1, 55)]
    assert rows(agg.progress_student(db), *shown) == [(3, 1, 0, 1, 40)]


def test_completion_by_course_ignores_students_without_graded_marks(spark):
    db = book(spark, courses=[course(1)], assessments=[assessment(11, 1, weight=50)],
              marks=[mark(11, 1, 100), mark(11, 2, None)], final_exams=[final(1, 1, 10), final(1, 2, 90), final(1, 3, 90)])
    assert rows(agg.avg_completion_by_course(db)) == [("Course 1", 53.0)]


def test_same_named_courses_are_merged_by_name(spark):
    db = book(spark, courses=[course(1, "X"), course(2, "X")], course_user=[enrolment(1, 1), enrolment(1, 2)],
              final_exams=[final(1, 1, 10, 1.0), final(2, 1, 20, 2.0), final(2, 2, 60, 4.0)])
    assert rows(agg.students_by_course(db)) == [("X", 2)]
    assert rows(agg.avg_final_by_course(db)) == [("X", 30.0)]
    assert rows(agg.avg_gpa_by_course(db)) == [("X", 2.3333)]


def test_report_keeps_ungraded_totals_apart_from_zero(spark):
    db = book(spark, users=[student(1)], courses=[course(1)],
              assessments=[assessment(11, 1, kind="quiz"), assessment(12, 1, kind="final")],
              marks=[mark(11, 1, None), mark(12, 1, 100)], final_exams=[final(1, 1, 60)])
    row = reports.advisee_report(db).collect()[0]
    assert (row.quiz, row.lab, row.final, row.total, row.status) == (None, 0.0, 60, 60.0, "B-")


def test_duplicate_final_rows_use_the_lowest_id(spark):
    db = book(spark, final_exams=[final(1, 1, 70, id=9), final(1, 1, 40, id=3)])
    assert rows(rank.final_for_mark_group(db), "final_mark") == [(40,)]


def test_newest_rows_break_equal_times_by_id(spark):
    later = datetime(2024, 2, 1)
    db = book(spark, notifications=[(i, 1, f"n{i}", "m", 0, later if i == 3 else T0) for i in range(1, 9)])
    assert rows(rank.recent_notifications(db), "position", "id") == [(1, 3), (2, 8), (3, 7), (4, 6), (5, 5)]
    assert [r.id for r in rank.notification_feed(db).collect()] == [3, 8, 7, 6, 5, 4, 2, 1]


def test_note_feed_filters_by_course_only_when_asked(spark):
    db = book(spark, advisor_notes=[(1, 9, 1, 5, "a", T0), (2, 9, 1, None, "b", T0), (3, 9, 2, 5, "c", T0)])
    assert [r.id for r in rank.note_feed(db).collect()] == [2, 1, 3]
    assert [r.id for r in rank.note_feed(db, course_id=5).collect()] == [1, 3]
    keys = spark.createDataFrame([(1,)], "student_id BIGINT")
    assert [r.id for r in rank.note_feed(db, keys=keys).collect()] == [2, 1]


def test_catalog_orders(spark):
    db = book(spark, courses=[(1, "B", "x", 1, 2023, datetime(2024, 3, 1)), (2, "A", "y", 2, 2023, T0), (3, "A", "z", 1, 2024, T0)])
    assert [r.id for r in rank.course_catalog(db).collect()] == [1, 3, 2]
    assert [r.id for r in rank.course_catalog(db, by_term=True).collect()] == [3, 2, 1]


def test_listings_are_ordered_and_restricted(spark):
    db = book(spark, users=[student(1, "Zed"), student(2, "Amy")], courses=[course(1), course(2)],
              course_user=[enrolment(1, 1), enrolment(2, 1), enrolment(2, 2)])
    assert [r.name for r in joins.course_roster(db, spark.createDataFrame([(1,)], "course_id BIGINT")).collect()] == ["Amy", "Zed"]
    assert [r.student_name for r in joins.enrolled_students(db).collect()] == ["Amy", "Zed", "Amy"]
    only = spark.createDataFrame([(2,)], "student_id BIGINT")
    assert rows(joins.courses_of_students(db, only), "course_id") == [(1,), (2,)]
    assert rows(keyed.restrict(db.course_user, only, db.course_user.user_id == only.student_id), "id") == [(201,), (202,)]


def test_header_keeps_pairs_without_enrolment(spark):
    db = book(spark, users=[student(1, matric=None)], courses=[course(1)])
    pairs = spark.createDataFrame([(1, 1), (1, 9), (8, 1)], "student_id BIGINT, course_id BIGINT")
    assert rows(joins.student_course_header(db, pairs), "student_id", "matric_number", "final_mark", "gpa") == [(1, "", 0, 0.0)]
    assert rows(joins.student_course_header(db, pairs, with_final=False), "matric_number") == [(None,)]


def test_in_sets_of_nothing_is_empty(spark):
    db = book(spark, marks=[mark(11, 1, 5)])
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "id BIGINT")
    assert rows(filters.in_sets(db.marks, ids(1), ids())) == []
    assert rows(filters.in_sets(db.marks, ids(1, 2), ids(11)), "student_id") == [(1,)]


def test_weight_rules_on_stored_data(spark):
    db = book(spark, courses=[course(1), course(2), course(3)],
              assessments=[assessment(11, 1, weight=70), assessment(21, 2, weight=71)])
    assert rows(quality.weight_violations(db)) == [(2, 71, True, True)]
    assert rows(agg.weights_per_course(db, without_assessment=21)) == [(1, 70), (2, 0), (3, 0)]


def test_dashboard_has_empty_lists_for_a_student_without_rows(spark):
    db = book(spark, users=[student(1)])
    card = reports.student_dashboard(db).collect()[0]
    assert (card.total_courses, card.average_mark, card.pending_remarks) == (0, 0.0, 0)
    assert card.recent_notifications == [] and card.enrolled_courses == [] and card.assessment_status == []


def test_analytics_parts(spark):
    db = book(spark, users=[student(1), student(2)], courses=[course(1)], course_user=[enrolment(1, 1), enrolment(2, 1)],
              assessments=[assessment(11, 1, weight=50)], marks=[mark(11, 1, 100)], final_exams=[final(1, 1, 100, 4.0)])
    parts = reports.lecturer_analytics(db)
    assert rows(parts["summary"], "total_students", "total_assessments", "total_remarks", "avg_completion", "avg_final_mark", "avg_gpa") == [
        (2, 1, 0, 40.0, 100.0, 4.0)]
    assert rows(parts["top_students"], "student_id", "total_completion") == [(1, 80.0), (2, 0.0)]
    assert rows(parts["doughnut"]) == [("0-25%", 1), ("26-50%", 0), ("51-75%", 0), ("76-100%", 1)]


def test_feeds_by_matric_number(spark):
    db = book(spark, users=[student(1), (2, "T", "t@x", "A2", None, "lecturer")], courses=[course(1)],
              assessments=[assessment(11, 1)], marks=[mark(11, 2, 5)], advisor_notes=[(1, 9, 1, None, "n", T0)])
    asked = spark.createDataFrame([("A1",), ("A2",)], "matric_number STRING")
    found, unknown = filters.resolve_matric(asked, db.users)
    assert rows(rank.note_feed(db, found.select("student_id")), "id") == [(1,)]
    assert rows(unknown, "matric_number") == [("A2",)]
    anyone, _ = filters.resolve_matric(asked, db.users, students_only=False)
    assert rows(agg.courses_with_marks(db, anyone.select("student_id")), "student_id", "course_id") == [(2, 1)]


def test_requested_pairs_need_no_enrolment(spark):
    db = book(spark, users=[student(1)], courses=[course(1), course(2)], assessments=[assessment(11, 1)])
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "student_id BIGINT, course_id BIGINT")
    assert rows(joins.mark_sheet(db, zero_fill=True, pairs=pairs), "assessment_id", "mark_obtained") == [(11, 0)]
    sheets = {r.course_id: r.marks for r in reports.mark_entry_sheet(db, pairs).collect()}
    assert [m.mark_obtained for m in sheets[1]] == [0] and sheets[2] == []
    cards = {r.course_id: r for r in reports.final_exam_card(db, pairs).collect()}
    assert cards[1].final_mark == 0 and [a.title for a in cards[1].assessments] == ["A11"] and cards[2].assessments == []
