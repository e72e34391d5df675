"""The registered queries by name: (session, directory of the star-schema files) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.batches import BATCH_TS, batch
from gradebook.functions.bands import gpa_from_mark, letter_grade
from gradebook.functions.numbers import from_points, reported
from gradebook.functions.scores import score_percent
from gradebook.functions.text import exam_notice
from gradebook.operators import aggregates as agg
from gradebook.operators import audit, facts, filters, joins, keyed, quality
from gradebook.operators import rankings as rank
from gradebook.operators.changes import delete, update
from gradebook.plans import maintenance, reports, whatif
from gradebook.plans.standings import Standings
from gradebook.plans.upkeep import Upkeep
from gradebook.sources.checkpoints import at_once, new_folder, written_once
from gradebook.sources.schema import BATCHES
from gradebook.sources.sinks import to_report_json
from gradebook.sources.star import derive
from gradebook.sources.tables import Gradebook, read_changes
from gradebook.sources.versions import VersionedTable


@lru_cache(maxsize=4)
def tables(spark: SparkSession, directory: str) -> Gradebook:
    """The lazy tables of a directory; kept so that dimension sizes are counted once."""
    return derive(spark, directory)


# Filters


def gradable_marks(db: Gradebook) -> DataFrame:
    return filters.gradable(facts.scored_marks(db), need_weight=True).select(
        "student_id", "assessment_id", "mark_obtained", "max_mark", "weight")


def in_sets(db: Gradebook) -> DataFrame:
    quizzes = db.assessments.where("type = 'quiz'").select("id")
    members = db.users.where("program = 'BUILDING'").select("id")
    return filters.in_sets(db.marks, members, quizzes).select("student_id", "assessment_id")


def resolved_matrics(db: Gradebook) -> DataFrame:
    found, unknown = filters.resolve_matric(batch(db, "matric_list"), db.users)
    return found.select("matric_number", "student_id").unionByName(unknown.drop("reason"), allowMissingColumns=True)


def required_fields_rejects(db: Gradebook) -> DataFrame:
    complete, rejected = filters.required_fields(batch(db, "notes_batch"), ["note", "meeting_date"])
    return rejected.select("seq", "reason").unionByName(
        complete.select("seq", F.lit(None).cast("string").alias("reason")))


# Scores and bands


def gpa_bands(db: Gradebook) -> DataFrame:
    mark = F.col("final_mark")
    return db.final_exams.select(
        "student_id", "course_id", "final_mark", gpa_from_mark(mark).alias("gpa"),
        letter_grade(mark).alias("letter"))


def score_models(db: Gradebook) -> DataFrame:
    rows = facts.scored_marks(db)
    models = {name: F.col(f"{name}_points") for name in ("ratio", "rounded", "completion", "report")}
    return rows.select(
        "student_id", "assessment_id",
        *[from_points(points).alias(name) for name, points in models.items()],
        reported(score_percent(F.col("mark_obtained"), F.col("max_mark")), 2).alias("percent"))


def exam_notices(db: Gradebook) -> DataFrame:
    gpa = gpa_from_mark(F.col("final_mark"))
    return db.final_exams.join(joins.courses_of(db, "course_name"), "course_id", "left").select(
        "student_id", "course_id", exam_notice(F.col("course_name"), F.col("course_id"), gpa).alias("message"))


# Nested reports, flattened


def student_dashboard_numbers(db: Gradebook) -> DataFrame:
    return reports.student_dashboard(db).select(
        "student_id", "student_name", "total_courses", "average_mark", "highest_mark", "lowest_mark", "pending_remarks")


def student_dashboard_entries(db: Gradebook) -> DataFrame:
    """Every list entry as (student, list, place in the list, id of the entry)."""
    cards = reports.student_dashboard(db)
    ids = {"recent_notifications": "id", "enrolled_courses": "course_id", "top_courses": "course_id",
           "advisor_notes": "id", "assessment_status": "course_id", "recent_remark_requests": "id"}

    def listed(name: str, key: str) -> Column:
        return F.transform(name, lambda entry, i: F.struct(
            F.lit(name).alias("list"), (i + 1).alias("place"), entry[key].alias("entry_id")))

    return cards.select("student_id", F.inline(F.concat(*[listed(name, key) for name, key in ids.items()])))


def student_profile_courses(db: Gradebook) -> DataFrame:
    return reports.student_profile(db).select(
        "student_id", "name", "email", "matric_number", "role", "average_final_mark",
        F.explode_outer("courses").alias("course")).select("*", "course.course_id", "course.course_code").drop("course")


def rankings_report_entries(db: Gradebook) -> DataFrame:
    header = ["course_code", "course_name", "semester", "year", "total_students", "class_average"]
    return reports.rankings_report(db).select("course_id", *header, F.inline_outer("students"))


def my_marks_items(db: Gradebook) -> DataFrame:
    return reports.my_marks(db).select("student_id", "course_id", "final_mark", "total_weighted", F.inline_outer("assessments"))


def assignment_grid_entries(db: Gradebook) -> DataFrame:
    return reports.assignment_grid_nested(db).select(
        "course_id", "student_id", "name", "matric_number", F.inline("assessments"))


def mark_entry_sheet_items(db: Gradebook) -> DataFrame:
    sheets = reports.mark_entry_sheet(db, batch(db, "header_pairs"))
    return sheets.select("student_id", "student_name", "course_id", "course_code", F.inline_outer("marks"))


def final_exam_card_items(db: Gradebook) -> DataFrame:
    cards = reports.final_exam_card(db, batch(db, "header_pairs"))
    return cards.select("student_id", "course_id", "final_mark", "gpa", F.inline_outer("assessments"))


def what_if_items(db: Gradebook) -> DataFrame:
    return whatif.what_if_items(db, batch(db, "scenarios")).drop("weighted_points")


# Changes


def already_present(db: Gradebook) -> DataFrame:
    present, absent = joins.already_present(batch(db, "enrol_batch"), db.final_exams, ["student_id", "course_id"])
    return present.withColumn("present", F.lit(True)).unionByName(absent.withColumn("present", F.lit(False)))


def add_notes_by_id(db: Gradebook) -> DataFrame:
    notes = batch(db, "notes_by_id")
    return maintenance.add_notes(db.advisor_notes, db.users, notes, BATCH_TS)[0].drop("id")


def delete_finals(db: Gradebook) -> DataFrame:
    pairs = batch(db, "enrol_batch").select("course_id", "student_id")
    return delete(db.final_exams, pairs, ["course_id", "student_id"])[0]


def update_roles(db: Gradebook) -> DataFrame:
    return update(db.users, batch(db, "roles_batch"), "id", ["role"])


def upsert_marks(db: Gradebook) -> DataFrame:
    return maintenance.save_marks(db.marks, batch(db, "marks_batch"), BATCH_TS).drop("id")


def insert_ignore_marks(db: Gradebook) -> DataFrame:
    return maintenance.assign_marks(db.marks, batch(db, "marks_batch"), BATCH_TS).drop("id")


def insert_ignore_enrolments(db: Gradebook) -> DataFrame:
    return maintenance.enrol(db.course_user, db.final_exams, batch(db, "enrol_batch"), BATCH_TS)[0].drop("id")


def enrol_batch(db: Gradebook) -> DataFrame:
    return maintenance.enrol(db.course_user, db.final_exams, batch(db, "enrol_batch"), BATCH_TS)[1].drop("id")


def insert_unique_remarks(db: Gradebook) -> DataFrame:
    added, rejected = maintenance.request_remarks(db.remark_requests, batch(db, "remarks_batch"), BATCH_TS)
    return added.select("student_id", "assessment_id", "message", "status").withColumn(
        "outcome", F.lit("stored")).unionByName(
        rejected.select("student_id", "assessment_id", "message", F.lit(None).cast("string").alias("status"),
                        F.lit("rejected").alias("outcome")))


def upsert_remarks(db: Gradebook) -> DataFrame:
    return maintenance.save_remarks(db.remark_requests, batch(db, "remark_edits"), BATCH_TS).drop("id")


def update_courses(db: Gradebook) -> DataFrame:
    return update(db.courses, batch(db, "courses_batch"), "id", ["course_code", "course_name", "semester", "year"])


def update_users(db: Gradebook) -> DataFrame:
    return update(db.users, batch(db, "users_batch"), "id", ["name", "email", "matric_number", "program", "role"])


def add_courses(db: Gradebook) -> DataFrame:
    return maintenance.add_courses(db.courses, batch(db, "new_courses"), BATCH_TS).drop("id")


def add_users(db: Gradebook) -> DataFrame:
    return maintenance.add_users(db.users, batch(db, "new_users"), BATCH_TS)[0].drop("id")


def delete_marks(db: Gradebook) -> DataFrame:
    return delete(db.marks, batch(db, "unassign_batch"), ["assessment_id", "student_id"])[0]


def delete_notes(db: Gradebook) -> DataFrame:
    return maintenance.delete_notes(db.advisor_notes, batch(db, "note_ids"))[1]


def move_enrolments(db: Gradebook) -> DataFrame:
    return maintenance.move_enrolments(db.course_user, db.final_exams, batch(db, "move_batch"))[0]


def move_enrolments_finals(db: Gradebook) -> DataFrame:
    return maintenance.move_enrolments(db.course_user, db.final_exams, batch(db, "move_batch"))[1]


def move_enrolments_rejects(db: Gradebook) -> DataFrame:
    return maintenance.move_enrolments(db.course_user, db.final_exams, batch(db, "move_batch"))[2].select("id", "reason")


def rejected_lines(db: Gradebook) -> DataFrame:
    """A batch of lines written and read again, of which some fields cannot be read or stored."""
    path = new_folder(db.spark, "lines")
    batch(db, "mark_lines").write.text(path)
    lines = read_changes(db.spark, path, BATCHES["marks"])
    return maintenance.rejected_changes(lines, "marks", db.marks).select("seq", "assessment_id", "student_id", "reason")


def _versioned(rows: DataFrame, keys: list[str]) -> VersionedTable:
    return VersionedTable.create(rows, new_folder(rows.sparkSession, "versions"), keys, id_col="id", rows_per_file=20_000)


def versioned_marks(db: Gradebook) -> DataFrame:
    """The latest version of a stored table after an upsert of its touched files."""
    table = _versioned(db.marks, maintenance.MARK_KEY)
    table.rewrite(batch(db, "marks_batch"), lambda marks, changes: maintenance.save_marks(marks, changes, BATCH_TS))
    return table.read().drop("id")


def earlier_marks(db: Gradebook) -> DataFrame:
    """The first version of a stored table, read after an upsert, a delete and a compaction."""
    table = _versioned(db.marks, maintenance.MARK_KEY)
    table.rewrite(batch(db, "marks_batch"), lambda marks, changes: maintenance.save_marks(marks, changes, BATCH_TS))
    table.delete(batch(db, "unassign_batch"))
    table.compact()
    return table.read(1)


def unassigned_marks(db: Gradebook) -> DataFrame:
    """Marks merged with their delete vectors when read."""
    table = _versioned(db.marks, maintenance.MARK_KEY)
    table.delete(batch(db, "unassign_batch"))
    return table.read()


def unassigned_marks_outcome(db: Gradebook) -> DataFrame:
    return _versioned(db.marks, maintenance.MARK_KEY).delete(batch(db, "unassign_batch"))[1]


def numbered_exams(db: Gradebook) -> DataFrame:
    """Exam rows of new enrolments, their ids numbered on from the highest."""
    table = _versioned(db.final_exams, maintenance.FINAL_KEY)
    table.rewrite(
        batch(db, "enrol_batch"), lambda exams, changes: maintenance.enrol(db.course_user, exams, changes, BATCH_TS)[1], new_ids="id")
    return table.read()


@lru_cache(maxsize=2)
def _kept(db: Gradebook) -> Upkeep:
    """Stored sums that were made before a batch of marks and one of final marks and followed both."""
    marks_batch, finals = batch(db, "marks_batch"), batch(db, "finals_batch")
    db.is_small("assessments")  # The tables are made and counted before the steps that share them.

    def changed_marks() -> VersionedTable:
        marks = _versioned(db.marks, maintenance.MARK_KEY)
        marks.rewrite(marks_batch, lambda rows, changes: maintenance.save_marks(rows, changes, BATCH_TS))
        return marks

    def changed_exams() -> VersionedTable:
        exams = _versioned(db.final_exams, maintenance.FINAL_KEY)
        exams.rewrite(finals, lambda rows, changes: maintenance.record_finals(db.replace(final_exams=rows), changes, BATCH_TS)[0])
        return exams

    # The sums are made from the tables as they were; the stored copies change beside that.
    kept, marks, exams = at_once(
        db.spark, lambda: Upkeep.create(db, new_folder(db.spark, "upkeep"), rows_per_file=5_000), changed_marks, changed_exams)
    kept.follow(db, {"marks": marks.difference(1, 2)})
    kept.follow(db, {"final_exams": exams.difference(1, 2)})
    return kept


def kept_rankings(db: Gradebook) -> DataFrame:
    """Ranks from stored blocks, after a batch of marks has moved the students that it names."""
    kept = Standings.create(rank.course_totals(db), new_folder(db.spark, "standings"), rows_per_file=2_000)
    changes = written_once(batch(db, "marks_batch"), "changes")
    touched = written_once(changes.select("student_id").distinct(), "touched")
    few = db.replace(
        marks=keyed.restrict(db.marks, touched, "student_id"), final_exams=keyed.restrict(db.final_exams, touched, "student_id"),
        course_user=db.course_user.join(touched.withColumnRenamed("student_id", "user_id"), "user_id", "left_semi").select(*db.course_user.columns))
    after = rank.course_totals(few.replace(marks=maintenance.save_marks(few.marks, changes, BATCH_TS)))
    kept.move(rank.course_totals(few), after)
    stored = kept.table.read()
    return kept.ranks(stored.withColumn("total_points", -F.col("below")))


def broken_key_audit(db: Gradebook) -> DataFrame:
    """The audit of tables that lack courses and users, repeat marks and miss students."""
    return audit.key_audit(db.replace(**{name: batch(db, f"broken_{name}") for name in ("users", "courses", "marks", "final_exams")}))


def rejected_changes(db: Gradebook) -> DataFrame:
    return maintenance.rejected_changes(batch(db, "unclear_marks"), "marks", db.marks).select("seq", "assessment_id", "student_id", "reason")


def withdraw_batch(db: Gradebook) -> DataFrame:
    enrolments, exams = maintenance.withdraw(db.course_user, db.final_exams, batch(db, "withdraw_ids"))
    return enrolments.select("user_id", "course_id", F.lit("enrolment").alias("kind")).unionByName(
        exams.select(F.col("student_id").alias("user_id"), "course_id", F.lit("final").alias("kind")))


def record_finals(db: Gradebook) -> DataFrame:
    return maintenance.record_finals(db, batch(db, "finals_batch"), BATCH_TS)[0].drop("id")


def record_finals_notices(db: Gradebook) -> DataFrame:
    return maintenance.record_finals(db, batch(db, "finals_batch"), BATCH_TS)[1].drop("id")


def final_weight_check(db: Gradebook) -> DataFrame:
    return quality.check_final_weight(db, batch(db, "finals_batch")).select(
        "seq", "course_id", "student_id", "accepted", "reason")


def add_notes(db: Gradebook) -> DataFrame:
    notes, _ = maintenance.add_notes(db.advisor_notes, db.users, batch(db, "notes_batch"), BATCH_TS, by_matric=True)
    return notes.drop("id")


def add_assessments(db: Gradebook) -> DataFrame:
    return maintenance.save_assessments(db.assessments, batch(db, "assessments_batch"), BATCH_TS)[0].drop("id")


def weight_check(db: Gradebook) -> DataFrame:
    return quality.check_weights(db.assessments, batch(db, "assessments_batch")).select(
        "seq", "course_id", "weight", "accepted", "reason")


_ON_TABLES: dict[str, Callable[[Gradebook], DataFrame]] = {
    "students": filters.students,
    "user_directory": filters.user_directory,
    "staff": filters.staff,
    "gradable_marks": gradable_marks,
    "in_sets": in_sets,
    "resolved_matrics": resolved_matrics,
    "required_fields_rejects": required_fields_rejects,
    "enrolments": joins.enrolments,
    "enrolled_students": joins.enrolled_students,
    "course_roster": joins.course_roster,
    "courses_of_students": joins.courses_of_students,
    "mark_sheet": joins.mark_sheet,
    "mark_sheet_zero_filled": lambda db: joins.mark_sheet(db, zero_fill=True),
    "mark_sheet_of_pairs": lambda db: joins.mark_sheet(db, zero_fill=True, pairs=batch(db, "header_pairs")),
    "student_course_header": lambda db: joins.student_course_header(db, batch(db, "header_pairs")),
    "assignment_grid": joins.assignment_grid,
    "final_exam_list": joins.final_exam_list,
    "assessments_with_course": joins.assessments_with_course,
    "assessments_of_students": joins.assessments_of_students,
    "remark_history": joins.remark_history,
    "table_totals": agg.table_totals,
    "distinct_students": agg.distinct_students,
    "students_by_course": agg.students_by_course,
    "course_count_per_student": agg.course_count_per_student,
    "final_mark_stats": agg.final_mark_stats_per_student,
    "avg_final_mark_per_student": agg.avg_final_mark_per_student,
    "pending_remarks": agg.pending_remarks_per_student,
    "assessment_completion": agg.assessment_completion,
    "progress_lecturer": agg.progress_lecturer,
    "progress_student": agg.progress_student,
    "avg_final_by_course": agg.avg_final_by_course,
    "avg_gpa_by_course": agg.avg_gpa_by_course,
    "avg_cgpa_by_course": agg.avg_cgpa_by_course,
    "avg_completion_by_course": agg.avg_completion_by_course,
    "overall_averages": agg.overall_averages,
    "cgpa_per_student": agg.cgpa_per_student,
    "standing_counts": agg.standing_counts,
    "cgpa_distribution": agg.cgpa_distribution,
    "completion_brackets": agg.completion_brackets,
    "average_completion": agg.average_completion,
    "student_totals": agg.student_totals,
    "type_pivot": agg.type_pivot,
    "courses_with_marks": agg.courses_with_marks,
    "weights_per_course": agg.weights_per_course,
    "course_rankings": rank.course_rankings,
    "class_stats": rank.class_stats,
    "rank_card": rank.rank_card,
    "recent_notifications": rank.recent_notifications,
    "recent_notes": rank.recent_notes,
    "recent_remarks": rank.recent_remarks,
    "top_courses_per_student": rank.top_courses_per_student,
    "first_remark_per_pair": rank.first_remark_per_pair,
    "final_for_mark_group": rank.final_for_mark_group,
    "top_students_by_completion": rank.top_students_by_completion,
    "top_students_by_cgpa": rank.top_students_by_cgpa,
    "at_risk_students": rank.at_risk_students,
    "advisee_list": rank.advisee_list,
    "performance_trend": rank.performance_trend,
    "notification_feed": rank.notification_feed,
    "note_feed": rank.note_feed,
    "note_feed_of_course": lambda db: rank.note_feed(db, course_id=5),
    "course_catalog": rank.course_catalog,
    "course_catalog_by_term": lambda db: rank.course_catalog(db, by_term=True),
    "gpa_bands": gpa_bands,
    "score_models": score_models,
    "exam_notices": exam_notices,
    "already_present": already_present,
    "upsert_marks": upsert_marks,
    "insert_ignore_marks": insert_ignore_marks,
    "insert_ignore_enrolments": insert_ignore_enrolments,
    "enrol_batch": enrol_batch,
    "insert_unique_remarks": insert_unique_remarks,
    "upsert_remarks": upsert_remarks,
    "update_courses": update_courses,
    "update_users": update_users,
    "add_courses": add_courses,
    "add_users": add_users,
    "delete_marks": delete_marks,
    "delete_notes": delete_notes,
    "delete_finals": delete_finals,
    "update_roles": update_roles,
    "add_notes_by_id": add_notes_by_id,
    "move_enrolments": move_enrolments,
    "move_enrolments_finals": move_enrolments_finals,
    "move_enrolments_rejects": move_enrolments_rejects,
    "rejected_changes": rejected_changes,
    "rejected_lines": rejected_lines,
    "versioned_marks": versioned_marks,
    "earlier_marks": earlier_marks,
    "unassigned_marks": unassigned_marks,
    "unassigned_marks_outcome": unassigned_marks_outcome,
    "numbered_exams": numbered_exams,
    "key_audit": audit.key_audit,
    "broken_key_audit": broken_key_audit,
    "kept_rankings": kept_rankings,
    "kept_student_totals": lambda db: _kept(db).student_totals(db),
    "kept_cgpa_per_student": lambda db: _kept(db).cgpa_per_student(),
    "kept_avg_completion_by_course": lambda db: _kept(db).avg_completion_by_course(db),
    "kept_avg_final_by_course": lambda db: _kept(db).avg_final_by_course(db),
    "kept_avg_gpa_by_course": lambda db: _kept(db).avg_gpa_by_course(db),
    "kept_overall_averages": lambda db: _kept(db).overall_averages(),
    "kept_completion_brackets": lambda db: _kept(db).completion_brackets(),
    "kept_cgpa_distribution": lambda db: _kept(db).cgpa_distribution(),
    "kept_average_completion": lambda db: _kept(db).average_completion(),
    "withdraw_batch": withdraw_batch,
    "record_finals": record_finals,
    "record_finals_notices": record_finals_notices,
    "final_weight_check": final_weight_check,
    "add_notes": add_notes,
    "add_assessments": add_assessments,
    "weight_check": weight_check,
    "weight_violations": quality.weight_violations,
    "advisee_report": reports.advisee_report,
    "my_marks_totals": reports.my_marks_totals,
    "what_if_totals": lambda db: whatif.what_if_totals(db, batch(db, "scenarios")),
    "advisor_dashboard": reports.advisor_dashboard,
    "lecturer_analytics_summary": reports.lecturer_analytics_summary,
    "student_dashboard_numbers": student_dashboard_numbers,
    "student_dashboard_entries": student_dashboard_entries,
    "student_profile_courses": student_profile_courses,
    "rankings_report_entries": rankings_report_entries,
    "my_marks_items": my_marks_items,
    "assignment_grid_entries": assignment_grid_entries,
    "mark_entry_sheet_items": mark_entry_sheet_items,
    "final_exam_card_items": final_exam_card_items,
    "what_if_items": what_if_items,
    "student_dashboard": lambda db: to_report_json(reports.student_dashboard(db)),
    "rankings_report": lambda db: to_report_json(reports.rankings_report(db)),
    "student_profile": lambda db: to_report_json(reports.student_profile(db)),
    "my_marks": lambda db: to_report_json(reports.my_marks(db)),
    "assignment_grid_nested": lambda db: to_report_json(reports.assignment_grid_nested(db)),
    "lecturer_analytics_page": lambda db: to_report_json(reports.lecturer_analytics_page(db)),
    "restricted_marks": lambda db: keyed.restrict(db.marks, batch(db, "header_pairs").select("student_id").distinct(), "student_id"),
}


def _on_directory(query: Callable[[Gradebook], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return query(tables(spark, directory))
    return run


QUERIES = {name: _on_directory(query) for name, query in _ON_TABLES.items()}
