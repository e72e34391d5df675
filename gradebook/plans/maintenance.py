"""Changes that touch several tables or are guarded by a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.functions.bands import gpa_from_mark
from gradebook.functions.text import EXAM_NOTICE_TITLE, clean_text, exam_notice
from gradebook.operators import changes as apply
from gradebook.operators.filters import required_fields, resolve_matric
from gradebook.operators.joins import courses_of
from gradebook.operators.keyed import first_per_key, last_per_key
from gradebook.operators.quality import check_final_weight, check_weights
from gradebook.sources.checkpoints import written_once
from gradebook.sources.tables import Gradebook

ENROLMENT_KEY = ["user_id", "course_id"]
FINAL_KEY = ["course_id", "student_id"]
MARK_KEY = ["assessment_id", "student_id"]
REMARK_KEY = ["student_id", "assessment_id"]

# Fixed value: the reason of a move to an occupied place.
MOVE_TAKEN = "The student is enrolled in that course."


def _stamp(batch_ts: str) -> Column:
    return F.lit(batch_ts).cast("timestamp_ntz")


def _split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where("accepted").drop("accepted", "reason"), checked.where("NOT accepted").drop("accepted")


#: The columns by which the changes of a batch are matched.
BATCH_KEYS = {
    "marks": MARK_KEY, "finals": FINAL_KEY, "remarks": REMARK_KEY, "enrolments": ["student_id", "course_id"], "moves": ["id", "student_id", "course_id"],
    "assessments": ["course_id"], "courses": [], "users": [], "notes": [],
}


def rejected_changes(batch: DataFrame, kind: str, base: DataFrame | None = None) -> DataFrame:
    """The changes of a batch that every function here leaves out, with a reason; see ``validated``.

    With ``base``, the table they are meant for, also those with values that it cannot hold.
    """
    return apply.validated(batch, BATCH_KEYS[kind], base)[1]


def _usable(batch: DataFrame, kind: str, base: DataFrame | None = None) -> DataFrame:
    return apply.validated(batch, BATCH_KEYS[kind], base)[0]


def save_marks(marks: DataFrame, batch: DataFrame, batch_ts: str) -> DataFrame:
    """Set or insert marks; those that the table cannot hold, as a fraction in a column of whole numbers, are left out."""
    now = _stamp(batch_ts)
    return apply.upsert(
        marks, _usable(batch, "marks", marks), MARK_KEY, ["mark_obtained"],
        defaults={"id": apply.row_id(*map(F.col, MARK_KEY)), "created_at": now}, stamps={"updated_at": now})


def assign_marks(marks: DataFrame, batch: DataFrame, batch_ts: str) -> DataFrame:
    """Insert ungraded marks rows where none exist."""
    return apply.insert_ignore(
        marks, _usable(batch.drop("mark_obtained"), "marks").select("seq", *MARK_KEY), MARK_KEY,
        {"id": apply.row_id(*map(F.col, MARK_KEY)), "created_at": _stamp(batch_ts)})


def save_remarks(remarks: DataFrame, batch: DataFrame, batch_ts: str) -> DataFrame:
    """Set message and status of recheck requests, or insert them."""
    return apply.upsert(
        remarks, _usable(batch, "remarks"), REMARK_KEY, ["message", "status"],
        defaults={"id": apply.row_id(*map(F.col, REMARK_KEY)), "created_at": _stamp(batch_ts)})


def request_remarks(remarks: DataFrame, batch: DataFrame, batch_ts: str) -> tuple[DataFrame, DataFrame]:
    """New recheck requests with a trimmed message; incomplete or repeated ones are rejected."""
    usable, unusable = apply.validated(batch, [])
    shaped = lambda rows, *more: rows.select("seq", *REMARK_KEY, clean_text(F.col("message")).alias("message"), *more)
    complete, incomplete = required_fields(shaped(usable), ["student_id", "assessment_id"], text=["message"])
    incomplete = incomplete.unionByName(shaped(unusable, "reason"))
    added, repeated = apply.insert_unique(
        remarks, complete, REMARK_KEY, "A request for this assessment exists.",
        {"id": apply.row_id(*map(F.col, REMARK_KEY)), "status": F.lit("pending"), "created_at": _stamp(batch_ts)})
    return added, incomplete.unionByName(repeated)


def enrol(
    course_user: DataFrame, finals: DataFrame, batch: DataFrame, batch_ts: str
) -> tuple[DataFrame, DataFrame]:
    """Enrol students and give each a final exam row with mark 0; existing rows stay as they are."""
    now = _stamp(batch_ts)
    # Written once, as both tables take it.
    batch = written_once(_usable(batch, "enrolments").select("seq", "student_id", "course_id"), "enrolments")
    pairs = batch.select("seq", F.col("student_id").alias("user_id"), "course_id")
    enrolments = apply.insert_ignore(course_user, pairs, ENROLMENT_KEY, {
        "id": apply.row_id(*map(F.col, ENROLMENT_KEY)), "role": F.lit("student"), "created_at": now})
    exams = apply.insert_ignore(finals, batch.select("seq", *FINAL_KEY), FINAL_KEY, {
        "id": apply.row_id(*map(F.col, FINAL_KEY)), "final_mark": F.lit(0).cast("bigint"), "created_at": now})
    return enrolments, exams


def move_enrolments(
    course_user: DataFrame, finals: DataFrame, batch: DataFrame, batch_ts: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Set student and course of enrolment ids.

    Rejected are unknown ids, and moves to a pair of student and course that another enrolment held
    before the batch or that an earlier change takes; so pairs stay unique. When the course changes, the exam row of
    the *new* student at the *old* course moves along, unless the student has an exam at the new
    course. That mix of new and old is the rule as given. ``batch_ts`` is set as ``updated_at`` where the table has it.
    """
    usable, unusable = apply.validated(batch, BATCH_KEYS["moves"])
    stamps = {"updated_at": _stamp(batch_ts)} if batch_ts else None
    latest = last_per_key(usable, "id")
    stored = course_user.select("id", F.col("user_id").alias("_old_student"), F.col("course_id").alias("_old_course"))
    known = latest.join(stored, "id")
    unknown = latest.join(known.select("id"), "id", "left_anti").withColumn("reason", F.lit("Enrollment not found."))
    pair = ["student_id", "course_id"]
    held = stored.select(F.col("_old_student").alias("student_id"), F.col("_old_course").alias("course_id"), F.col("id").alias("_holder"))
    meeting = known.join(held, pair, "left").groupBy("id").agg(F.coalesce(F.max(F.col("_holder") != F.col("id")), F.lit(False)).alias("_held"))
    judged = known.join(meeting, "id")
    free = judged.where("NOT _held")
    first = first_per_key(free, pair, [F.asc("seq")]).select("id", F.lit(True).alias("_first"))
    placed = judged.join(first, "id", "left")
    accepted = placed.where("_first")
    taken = placed.where("_first IS NULL").withColumn("reason", F.lit(MOVE_TAKEN))
    enrolments = apply.update(course_user, accepted.withColumn("user_id", F.col("student_id")), "id", ["user_id", "course_id"], stamps)

    moves = accepted.where("_old_course <> course_id").select(
        "seq", "student_id", F.col("_old_course").alias("course_id"), F.col("course_id").alias("_target"))
    exams = finals.select(*FINAL_KEY)
    wanted = last_per_key(moves, FINAL_KEY).join(exams, FINAL_KEY, "left_semi")
    open_ = wanted.join(exams.withColumnRenamed("course_id", "_target"), ["student_id", "_target"], "left_anti")
    target = first_per_key(open_, ["student_id", "_target"], [F.asc("seq")]).select(*FINAL_KEY, "_target", F.lit(True).alias("_moved"))
    moved = finals.join(target, FINAL_KEY, "left")
    columns = [
        F.coalesce("_target", "course_id").alias(c) if c == "course_id"
        else F.when(F.col("_moved"), stamps[c]).otherwise(F.col(c)).alias(c) if stamps and c in stamps else F.col(c) for c in finals.columns]
    columns_of = batch.columns
    rejected = unknown.select(*[c for c in columns_of if c in unknown.columns], "reason").unionByName(
        taken.select(*[c for c in columns_of if c in taken.columns], "reason")).unionByName(unusable, allowMissingColumns=True)
    return enrolments, moved.select(*columns), rejected


def withdraw(course_user: DataFrame, finals: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete enrolments and their exam rows; unknown ids are ignored."""
    pairs = course_user.join(ids.select("id"), "id", "left_semi").select(
        F.col("user_id").alias("student_id"), "course_id")
    return apply.delete(course_user, ids, "id")[0], apply.delete(finals, pairs, FINAL_KEY)[0]


def record_finals(
    db: Gradebook, batch: DataFrame, batch_ts: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Save final marks with their GPA and notify the student of every accepted change."""
    now = _stamp(batch_ts)
    usable, unusable = apply.validated(batch, FINAL_KEY, db.final_exams)
    accepted, rejected = _split(check_final_weight(db, usable))
    rejected = rejected.unionByName(unusable, allowMissingColumns=True)
    graded = accepted.withColumn("gpa", gpa_from_mark(F.col("final_mark")))
    finals = apply.upsert(
        db.final_exams, graded, FINAL_KEY, ["final_mark", "gpa"],
        defaults={"id": apply.row_id(*map(F.col, FINAL_KEY)), "created_at": now}, stamps={"updated_at": now})
    notices = graded.join(courses_of(db, "course_name"), "course_id", "left").select(
        apply.row_id(F.lit("final exam"), F.col("student_id"), F.col("course_id"), F.col("seq"), now).alias("id"),
        F.col("student_id").alias("user_id"), F.lit(EXAM_NOTICE_TITLE).alias("title"),
        exam_notice(F.col("course_name"), F.col("course_id"), F.col("gpa")).alias("message"),
        F.lit(0).alias("is_read"), now.alias("created_at"))
    return finals, apply.append(db.notifications, notices), rejected


def add_notes(
    notes: DataFrame, users: DataFrame, batch: DataFrame, batch_ts: str, by_matric: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Append advisor notes, addressed by student id or by matric number."""
    required = ["note", "meeting_date"] if by_matric else ["advisor_id", "student_id", "note"]
    usable, unusable = apply.validated(batch, [])
    complete, rejected = required_fields(usable, required)
    if by_matric:
        complete, unknown = resolve_matric(complete, users)
        rejected = rejected.unionByName(unknown)
    now = _stamp(batch_ts)
    rows = complete.withColumns({
        "id": apply.row_id(F.col("advisor_id"), F.col("student_id"), F.col("seq"), now), "created_at": now})
    return apply.append(notes, rows), rejected.unionByName(unusable, allowMissingColumns=True)


def delete_notes(notes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete notes by id and report for each id whether it existed."""
    return apply.delete(notes, ids, "id")


def add_courses(courses: DataFrame, batch: DataFrame, batch_ts: str) -> DataFrame:
    now = _stamp(batch_ts)
    return apply.append(courses, _usable(batch, "courses").withColumns({
        "id": apply.row_id(F.col("course_code"), F.col("seq"), now), "created_at": now}))


def add_users(users: DataFrame, batch: DataFrame, batch_ts: str) -> tuple[DataFrame, DataFrame]:
    """Append users that have a name, an email and a role."""
    usable, unusable = apply.validated(batch, [])
    complete, rejected = required_fields(usable, ["name", "email", "role"])
    rejected = rejected.unionByName(unusable, allowMissingColumns=True)
    rows = complete.withColumn("id", apply.row_id(F.col("email"), F.col("seq"), _stamp(batch_ts)))
    return apply.append(users, rows), rejected


def save_assessments(
    assessments: DataFrame, batch: DataFrame, batch_ts: str
) -> tuple[DataFrame, DataFrame]:
    """Insert (no id) and edit (id) assessments within the weight limit."""
    usable, unusable = apply.validated(batch, ["course_id"], assessments)
    accepted, rejected = _split(check_weights(assessments, usable))
    rejected = rejected.unionByName(unusable, allowMissingColumns=True)
    edited = apply.update(
        assessments, accepted.where("id IS NOT NULL"), "id", ["course_id", "title", "type", "max_mark", "weight"],
        {"updated_at": _stamp(batch_ts)})
    now = _stamp(batch_ts)
    fresh = accepted.where("id IS NULL").withColumns({
        "id": apply.row_id(F.col("course_id"), F.col("title"), F.col("seq"), now), "created_at": now, "updated_at": now})
    return apply.append(edited, fresh), rejected
