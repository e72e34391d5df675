"""Reports kept up to date: stored sums and counts that follow batches by signed differences.

A batch rewrites a few files of a versioned table. The rows of those files before and after, counted with -1
and +1, change three stored tables, which are versioned as well:

* ``students``: per student the sums and counts of every course (a student has few),
* ``courses``: per course the sums and counts over its students,
* ``measures``: numbers over all students, such as how many lie in a band.

Each follows from the difference of the one before, so a batch reads and writes the touched files of each table and no others.
Rows that did not change cancel out. A maximum cannot be taken back from a sum: it is taken anew over the courses of each touched student.

(student, course) has at most one exam row, and enrolled students are users, as ``audit.key_audit`` checks. Assessments
must not change in between; after a change of theirs the tables are made again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.functions.bands import (
    CGPA_BANDS,
    CGPA_FLOOR,
    COMPLETION_BRACKETS,
    COMPLETION_TOP,
    STANDING_BANDS,
    STANDING_FLOOR,
    cgpa_band,
    completion_bracket,
    standing,
)
from gradebook.functions.numbers import POINT, from_points, reported, to_points
from gradebook.functions.scores import final_share
from gradebook.operators.facts import PAIR, scored_marks
from gradebook.operators.joins import enrolled
from gradebook.sources.checkpoints import at_once, written_once
from gradebook.sources.tables import BROADCAST_ROWS, Gradebook, has_at_most
from gradebook.sources.versions import VersionedTable

#: What is summed per student and course: numbers of rows, micro-points, and values that only one row has.
SUMS = ["enrolments", "marks", "graded", "completion_points", "exams", "finals", "final_points", "gpas", "gpa_points"]
COURSE_SUMS = ["finals", "final_points", "gpas", "gpa_points", "completions", "completion_points", "cgpas", "cgpa_points"]
_BANDS = [*[label for _, label in CGPA_BANDS], CGPA_FLOOR]
_STANDINGS = [*[label for _, label in STANDING_BANDS], STANDING_FLOOR]
_BRACKETS = [*[label for _, label in COMPLETION_BRACKETS], COMPLETION_TOP]
_TABLES = ("marks", "final_exams", "course_user")


class Upkeep:
    """The three stored tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str, **options) -> None:
        self.students, self.courses, self.measures = (
            VersionedTable(spark, f"{root}/{name}", **options) for name in ("students", "courses", "measures"))

    @classmethod
    def create(cls, db: Gradebook, root: str, **options) -> Upkeep:
        """Sum up all of ``db``."""
        kept = cls(db.spark, root, **options)
        rows = _rows(db, {name: getattr(db, name) for name in _TABLES}).withColumn("sign", F.lit(1))
        students = written_once(_by_student(_summed(rows, PAIR, SUMS)), "students")
        signed = students.withColumn("sign", F.lit(1))
        at_once(
            db.spark,
            lambda: VersionedTable.create(students, kept.students.root, ["student_id"], **options),
            lambda: VersionedTable.create(_by_course(signed), kept.courses.root, ["course_id"], **options),
            lambda: VersionedTable.create(_by_measure(signed), kept.measures.root, ["measure"], **options))
        return kept

    def follow(self, db: Gradebook, differences: dict[str, tuple[DataFrame, DataFrame]]) -> None:
        """Take over changes of marks, final_exams and course_user, given as the touched rows before and after.

        See ``VersionedTable.difference``. ``db`` gives the assessments.
        """
        if unknown := differences.keys() - set(_TABLES):
            raise ValueError(f"no sums of {sorted(unknown)} are kept")
        signed = [
            _rows(db, {name: pair[side] for name, pair in differences.items()}).withColumn("sign", F.lit(sign))
            for side, sign in ((0, -1), (1, 1))]
        delta = _once(_summed(reduce(DataFrame.unionByName, signed), PAIR, SUMS), SUMS)
        if delta.isEmpty():
            return
        old = self.students.commit().version
        new = self.students.rewrite(delta, _students_after)
        before, after = self.students.difference(old, new)
        both = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))
        # Students that did not change cancel out. They are left out first only if that needs no shuffle.
        if has_at_most(touched := delta.select("student_id").distinct(), BROADCAST_ROWS):
            both = both.join(F.broadcast(touched), "student_id", "left_semi")

        def take_over(table: VersionedTable, change: DataFrame, key: str, columns: list[str]) -> None:
            change = _once(change, columns)
            if not change.isEmpty():
                table.rewrite(change, lambda stored, changes: _added(stored, changes, [key], columns))

        at_once(
            self.students.spark,
            lambda: take_over(self.courses, _by_course(both), "course_id", COURSE_SUMS),
            lambda: take_over(self.measures, _by_measure(both), "measure", ["value"]))

    # Reports

    def student_totals(self, db: Gradebook) -> DataFrame:
        names = db.users.select(F.col("id").alias("student_id"), F.col("name").alias("student_name"), "matric_number")
        return self.students.read().where(_enrolled()).join(names, "student_id").select(
            "student_id", "student_name", "matric_number", from_points(_mark_points()).alias("assessment_weight"),
            from_points(_final_points()).alias("final_weight"), from_points(_mark_points() + _final_points()).alias("total_completion"),
            F.coalesce(from_points(F.array_max(F.transform(_where_enrolled(), _gpa_points))), F.lit(0.0)).alias("gpa"))

    def cgpa_per_student(self) -> DataFrame:
        return self.students.read().where(_examined()).select("student_id", _cgpa().alias("cgpa"))

    def avg_final_by_course(self, db: Gradebook) -> DataFrame:
        return self._mean_by_name(db, "final_points", "finals", "avg_final_mark", 4)

    def avg_gpa_by_course(self, db: Gradebook) -> DataFrame:
        return self._mean_by_name(db, "gpa_points", "gpas", "avg_gpa", 4)

    def avg_completion_by_course(self, db: Gradebook) -> DataFrame:
        return self._mean_by_name(db, "completion_points", "completions", "avg_completion", 4)

    def overall_averages(self) -> DataFrame:
        sums = self.courses.read().agg(*[F.sum(c).alias(c) for c in COURSE_SUMS])
        return sums.select(
            F.coalesce(reported(_mean("final_points", "finals"), 1), F.lit(0.0)).alias("avg_final_mark"),
            F.coalesce(reported(_mean("gpa_points", "gpas"), 2), F.lit(0.0)).alias("avg_gpa"))

    def completion_brackets(self) -> DataFrame:
        values = self._values()
        return values.select(F.inline(F.array(*[
            F.struct(F.lit(label).alias("bracket"), _value(f"bracket {label}").alias("student_count")) for label in _BRACKETS])))

    def cgpa_distribution(self) -> DataFrame:
        return self._values().select(*[_value(f"band {label}").alias(label) for label in _BANDS])

    def standing_counts(self) -> DataFrame:
        """Without the number of all students, which no sum of marks or exams holds."""
        return self._values().select(
            *[_value(f"standing {label}").alias(name) for label, name in zip(_STANDINGS, ("good_standing", "warning", "probation"))],
            reported(F.try_divide(_value("cgpa points"), _value("cgpas") * F.lit(float(POINT))), 2).alias("avg_cgpa"))

    def average_completion(self) -> DataFrame:
        mean = F.try_divide(_value("completion points"), _value("enrolled students") * F.lit(float(POINT)))
        return self._values().select(F.coalesce(reported(mean, 1), F.lit(0.0)).alias("avg_completion"))

    def _values(self) -> DataFrame:
        """All measures as one map; there are a few."""
        return self.measures.read().agg(F.map_from_entries(F.collect_list(F.struct("measure", "value"))).alias("values"))

    def _mean_by_name(self, db: Gradebook, points: str, n: str, name: str, digits: int) -> DataFrame:
        names = db.courses.select(F.col("id").alias("course_id"), "course_name")
        sums = names.join(self.courses.read(), "course_id", "left").groupBy("course_name").agg(F.sum(points).alias("p"), F.sum(n).alias("n"))
        return sums.select("course_name", F.coalesce(reported(_mean("p", "n"), digits), F.lit(0.0)).alias(name))


# From rows to sums


def _rows(db: Gradebook, tables: dict[str, DataFrame]) -> DataFrame:
    """The given tables' rows as (student, course) with what each adds to the sums."""
    given = db.replace(**tables)
    one = F.lit(1).cast("bigint")
    parts = []
    if "course_user" in tables:
        parts.append(enrolled(given).select(*PAIR, one.alias("enrolments")))
    if "marks" in tables:
        points = F.col("completion_points")
        parts.append(scored_marks(given).select(
            *PAIR, one.alias("marks"), F.when(points.isNotNull(), one).alias("graded"), points))
    if "final_exams" in tables:
        mark, gpa = F.col("final_mark"), F.col("gpa")
        parts.append(given.final_exams.select(
            *PAIR, one.alias("exams"), F.when(mark.isNotNull(), one).alias("finals"), to_points(mark).alias("final_points"),
            F.when(gpa.isNotNull(), one).alias("gpas"), to_points(gpa).alias("gpa_points")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.select(*PAIR, *[(F.col(c) if c in rows.columns else F.lit(None)).cast("bigint").alias(c) for c in SUMS])


def _summed(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The signed sums per key."""
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col("sign") * F.col(c)), F.lit(0)).alias(c) for c in columns])


def _once(delta: DataFrame, columns: list[str]) -> DataFrame:
    """The keys whose sums change, written once."""
    return written_once(delta.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in columns])), "delta")


def _by_student(pairs: DataFrame, *kept: Column) -> DataFrame:
    """One row per student with the courses that anything is left of; no row without any."""
    left = pairs.where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in ("enrolments", "marks", "exams")]))
    return left.groupBy("student_id").agg(F.array_sort(F.collect_list(F.struct("course_id", *SUMS))).alias("courses"), *kept)


def _students_after(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """The students' rows with the delta added; ``stored`` has columns of its own, which stay."""
    own = [c for c in stored.columns if c not in ("student_id", "courses")]
    pairs = stored.select("student_id", *own, F.inline("courses")).unionByName(delta, allowMissingColumns=True)
    # Brought together by student, which serves the sums per pair and per student.
    pairs = pairs.repartition("student_id")
    # A student's courses and the changes of them meet by pair; what is stored with a student is the same in all of their rows.
    known = [F.max(c).alias(c) for c in own]
    summed = pairs.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in SUMS], *known)
    return _by_student(summed, *known).select(*stored.columns)


def _added(stored: DataFrame, delta: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    own = [c for c in stored.columns if c not in keys and c not in columns]
    both = stored.unionByName(delta, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns], *[F.max(c).alias(c) for c in own]).select(*stored.columns)


def _by_course(students: DataFrame) -> DataFrame:
    """Signed sums per course over the students' rows."""
    each = students.select("sign", F.inline("courses"))
    share = F.coalesce(to_points(final_share(_final_mark(F.col))), F.lit(0))
    counted = (F.col("marks") > 0) & (F.col("graded") > 0)
    rows = each.select(
        "sign", "course_id", "finals", "final_points", "gpas", "gpa_points",
        F.when(counted, 1).alias("completions"), F.when(counted, F.col("completion_points") + share).alias("completion_points"),
        F.when(F.col("gpas") > 0, 1).alias("cgpas"), F.when(F.col("gpas") > 0, F.col("gpa_points")).alias("cgpa_points"))
    return _summed(rows, ["course_id"], COURSE_SUMS)


def _by_measure(students: DataFrame) -> DataFrame:
    """Signed numbers over all students, by name."""
    # One number of each kind per student first: every measure reads them, and none walks the courses again.
    students = students.select("sign", _cgpa().alias("cgpa"), (_mark_points() + _final_points()).alias("total"), _enrolled().alias("enrolled"))
    students = students.select(
        "*", cgpa_band(F.col("cgpa")).alias("band"), standing(F.col("cgpa")).alias("standing"), completion_bracket(from_points(F.col("total"))).alias("bracket"))
    cgpa, total, enrolled_ = F.col("cgpa"), F.col("total"), F.col("enrolled")
    is_one = lambda value, label: F.when(value == label, 1).otherwise(0)
    has_cgpa = cgpa.isNotNull()
    measures = {
        **{f"band {label}": is_one(F.col("band"), label) for label in _BANDS},
        **{f"standing {label}": F.when(has_cgpa, is_one(F.col("standing"), label)).otherwise(0) for label in _STANDINGS},
        "cgpas": F.when(has_cgpa, 1).otherwise(0),
        "cgpa points": F.coalesce(to_points(cgpa), F.lit(0)),
        **{f"bracket {label}": F.when(enrolled_, is_one(F.col("bracket"), label)).otherwise(0) for label in _BRACKETS},
        "enrolled students": F.when(enrolled_, 1).otherwise(0),
        "completion points": F.when(enrolled_, total).otherwise(0),
    }
    sums = students.agg(*[F.coalesce(F.sum(F.col("sign") * v.cast("decimal(20,0)")), F.lit(0)).cast("bigint").alias(f"m{i}") for i, v in enumerate(measures.values())])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(f"m{i}").alias("value")) for i, name in enumerate(measures)])))


# Of one student's row


def _final_mark(get: Callable[[str], Column]) -> Column:
    """The only final mark of a course, NULL without one; ``get`` gives a course's sums by name."""
    return F.when(get("finals") > 0, from_points(get("final_points")))


def _gpa_points(course: Column) -> Column:
    return F.when(course["gpas"] > 0, course["gpa_points"])


def _where_enrolled() -> Column:
    return F.filter("courses", lambda c: c["enrolments"] > 0)


def _enrolled() -> Column:
    return F.exists("courses", lambda c: c["enrolments"] > 0)


def _examined() -> Column:
    return F.exists("courses", lambda c: c["exams"] > 0)


def _total(courses: Column | str, name: str) -> Column:
    return F.aggregate(F.transform(courses, lambda c: c[name]), F.lit(0).cast("bigint"), lambda s, v: s + v)


def _mark_points() -> Column:
    return _total(_where_enrolled(), "completion_points")


def _final_points() -> Column:
    return F.coalesce(to_points(final_share(F.array_max(F.transform(_where_enrolled(), lambda c: _final_mark(c.getField))))), F.lit(0).cast("bigint"))


def _cgpa() -> Column:
    """The mean of a student's GPAs, NULL without any."""
    return F.try_divide(_total("courses", "gpa_points").cast("double"), _total("courses", "gpas") * F.lit(float(POINT)))


def _mean(points: str, n: str) -> Column:
    return F.try_divide(F.col(points).cast("double"), F.col(n) * F.lit(float(POINT)))


def _value(name: str) -> Column:
    return F.coalesce(F.element_at("values", name), F.lit(0))
