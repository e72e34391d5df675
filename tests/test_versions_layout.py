"""Files that a batch writes lie in as few folders as its touched files allow, and many files are read by their folders."""

import pytest
from books import batch, book, enrolment, mark, rows
from pyspark.sql import functions as F

from gradebook.operators import aggregates as agg
from gradebook.plans import maintenance as m
from gradebook.plans import upkeep
from gradebook.sources import versions
from gradebook.sources.checkpoints import at_once
from gradebook.sources.versions import VersionedTable

TS = "2024-05-05 10:00:00"


def save(marks, changes):
    return m.save_marks(marks, changes, TS)


@pytest.fixture
def marks(spark, tmp_path):
    """60 assessments of 20 marks, in files of at most 20 rows."""
    db = book(spark, marks=[mark(a, s, a) for a in range(60) for s in range(20)])
    return VersionedTable.create(db.marks, f"{tmp_path}/marks", m.MARK_KEY, id_col="id", rows_per_file=20)


def parts(table, version=None):
    return {r._file.rsplit("/", 1)[0] for r in table.manifest(version).collect()}


def ranges(table):
    return sorted((tuple(r.low), tuple(r.high)) for r in table.manifest().collect())


def test_a_batch_over_all_files_writes_one_folder(spark, marks, monkeypatch):
    assert marks.manifest().count() > versions.BY_NAME
    changes = batch(spark, "marks", [(s * 60 + a, a, s, 50.0) for a in range(60) for s in range(20)] + [(9000 + a, a, 99, 1.0) for a in range(-1, 61)])
    paths = []
    # The files of a version are given to Spark by the folder, as all of it is wanted.
    stored = VersionedTable._stored
    monkeypatch.setattr(VersionedTable, "_stored", lambda self, schema, names: paths.append(stored(self, schema, names)) or paths[-1])
    marks.rewrite(changes, save)
    assert len(parts(marks)) == 1
    assert "InMemoryFileIndex(1 paths)" in paths[0]._jdf.queryExecution().executedPlan().toString()
    assert marks.read().count() == 60 * 20 + 62 and marks.read().where("mark_obtained = 50").count() == 60 * 20
    assert all(a[1] < b[0] for a, b in zip(ranges(marks), ranges(marks)[1:]))
    assert max(r.rows for r in marks.manifest().collect()) <= 40
    before, after = marks.difference(1, 2)
    assert before.count() == 1200 and after.count() == 1262


def test_files_between_stay_as_they_are(spark, marks):
    """Many files of a folder, but not all: no other is read, and no new file reaches over one that stays."""
    stay = {10, 11, 30}
    old = {r._file: (r.low[0], r.high[0]) for r in marks.manifest().collect()}
    changes = batch(spark, "marks", [(a, a, 5, 77.0) for a in range(60) if a not in stay and a - 1 not in stay and a + 1 not in stay])
    read = []

    def change(stored, changes):
        read.append({"/".join(n.split("/")[-4:]) for n in stored.inputFiles() if "/data/" in n})
        return save(stored, changes)

    marks.rewrite(changes, change)
    left = {r._file for r in marks.manifest().collect()} & old.keys()
    assert left and read[0] == old.keys() - left
    assert len(parts(marks) - parts(marks, 1)) <= 3
    assert all(a[1] < b[0] for a, b in zip(ranges(marks), ranges(marks)[1:]))
    assert marks.read().count() == 1200 and marks.read().where("mark_obtained = 77").count() == changes.count()
    assert rows(marks.read(1), "mark_obtained") == sorted((a,) for a in range(60) for _ in range(20))


@pytest.mark.parametrize("limit", [0, 1000])
def test_unchanged_students_of_touched_files_cancel_out(spark, tmp_path, monkeypatch, limit):
    """With more touched students than may be broadcast no join leaves the others out."""
    monkeypatch.setattr(upkeep, "BROADCAST_ROWS", limit)
    from books import assessment, course, student
    db = book(
        spark, users=[student(s) for s in range(1, 21)], courses=[course(1), course(2)], course_user=[enrolment(s, c) for s in range(1, 21) for c in (1, 2)],
        assessments=[assessment(10, 1, weight=40), assessment(20, 2, weight=60)], marks=[mark(10, s, s * 4) for s in range(1, 21)])
    kept = upkeep.Upkeep.create(db, f"{tmp_path}/kept", rows_per_file=7)
    stored = VersionedTable.create(db.marks, f"{tmp_path}/marks", m.MARK_KEY, rows_per_file=50)
    stored.rewrite(batch(spark, "marks", [(1, 10, 3, 99.0), (2, 20, 12, 88.0)]), save)
    kept.follow(db, {"marks": stored.difference(1, 2)})
    db = db.replace(marks=stored.read())
    assert rows(kept.avg_completion_by_course(db)) == rows(agg.avg_completion_by_course(db))
    assert rows(kept.completion_brackets()) == rows(agg.completion_brackets(db))
    assert rows(kept.student_totals(db)) == rows(agg.student_totals(db))


def test_steps_at_once(spark):
    assert at_once(spark, lambda: spark.range(3).count(), lambda: spark.range(5).agg(F.sum("id")).first()[0]) == [3, 10]
    done = []

    def fails():
        raise ValueError("one")

    with pytest.raises(ValueError):
        at_once(spark, fails, lambda: done.append(spark.range(2).count()))
    assert done == [2]
