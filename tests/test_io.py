"""Reading and writing tables, change files and reports."""

import json
import random
import sqlite3
from datetime import datetime

import pytest
from books import T0, assessment, book, course, enrolment, mark, rows, student

import gradebook
from gradebook.plans import reports
from gradebook.sources.schema import BATCHES, TABLES
from gradebook.sources.sinks import write_report_json, write_table
from gradebook.sources.tables import Gradebook, load_jdbc, read_changes


@pytest.fixture
def db(spark):
    return book(spark, users=[student(1), student(2, matric=None)], courses=[course(1)],
                course_user=[enrolment(1, 1), enrolment(2, 1)], assessments=[assessment(11, 1)], marks=[mark(11, 1, None)])


def test_tables_survive_a_round_trip(spark, db, tmp_path):
    for name in TABLES:
        write_table(getattr(db, name), f"{tmp_path}/{name}")
    loaded = gradebook.load(spark, str(tmp_path))
    for name in TABLES:
        assert rows(getattr(loaded, name)) == rows(getattr(db, name))
        assert getattr(loaded, name).schema.simpleString() == getattr(db, name).schema.simpleString()


def test_a_table_version_is_never_overwritten(db, tmp_path):
    write_table(db.users, f"{tmp_path}/users", partition_by=["role"])
    assert (tmp_path / "users" / "role=student").is_dir()
    with pytest.raises(Exception, match="already exists"):
        write_table(db.users, f"{tmp_path}/users")


def test_changes_default_to_null_and_keep_broken_lines(spark, tmp_path):
    file = tmp_path / "changes.json"
    file.write_text('{"seq": 1, "assessment_id": 11, "student_id": 1, "mark_obtained": 7.5}\n{"seq": 2, "assessment_id": 11}\n{broken\n\n[1]\n7\nnull\n')
    read = read_changes(spark, str(file), BATCHES["marks"])
    assert rows(read, "seq", "student_id", "mark_obtained", "_corrupt_record") == [
        (None, None, None, "7"), (None, None, None, "[1]"), (None, None, None, "null"), (None, None, None, "{broken"), (1, 1, 7.5, None), (2, None, None, None)]


FIELDS = "n BIGINT, i INT, d DOUBLE, s STRING, t TIMESTAMP_NTZ"


@pytest.mark.parametrize("line,values,reason", [
    ('{"n": 7, "i": 7.0, "d": 1e2, "s": "x", "t": "2024-05-05 10:00:00"}', (7, 7, 100.0, "x", datetime(2024, 5, 5, 10)), None),
    ('{"n": " 7 ", "i": "7.0", "d": "1.5", "s": 5, "t": "2024-05-05"}', (7, 7, 1.5, "5", datetime(2024, 5, 5)), None),
    ('{"n": null, "s": true, "other": [1]}', (None, None, None, "true", None), None),
    ('{"n": 72.5, "i": 3}', (None, 3, None, None, None), "n needs a whole number: 72.5"),
    ('{"n": "abc", "d": "abc"}', (None,) * 5, 'n needs a whole number: "abc"; d needs a number: "abc"'),
    ('{"i": 2147483648, "n": 9223372036854775808}', (None,) * 5, "n needs a whole number: 9223372036854775808; i needs a whole number: 2147483648"),
    ('{"n": true, "d": false, "s": {"a": 1}, "t": 5}', (None,) * 5,
     'n needs a whole number: true; d needs a number: false; s needs a text: {"a":1}; t needs a time: 5'),
    ('{"n": [], "d": "NaN", "t": "yesterday", "s": ""}', (None, None, None, "", None), 'n needs a whole number: []; d needs a number: "NaN"; t needs a time: "yesterday"'),
])
def test_each_field_of_a_change_is_read_on_its_own(spark, tmp_path, line, values, reason):
    (tmp_path / "changes.json").write_text(line + "\n")
    read = read_changes(spark, f"{tmp_path}/changes.json", FIELDS).collect()
    assert [tuple(r) for r in read] == [(*values, reason, None)]


def test_report_json_keeps_nulls_and_nesting(spark, db, tmp_path):
    write_report_json(reports.my_marks(db), f"{tmp_path}/marks")
    lines = [json.loads(line) for part in (tmp_path / "marks").glob("part-*") for line in part.read_text().splitlines()]
    first = next(line for line in lines if line["student_id"] == 1)
    assert first["final_mark"] is None and first["total_weighted"] == 0.0
    assert first["assessments"] == [{
        "assessment_id": 11, "title": "A11", "type": "quiz", "mark_obtained": None, "max_mark": 100, "weight": 10,
        "weighted_mark": None}]
    write_report_json(db.users.where("id = 1"), f"{tmp_path}/pretty", pretty=True)
    text = "".join(part.read_text() for part in (tmp_path / "pretty").glob("part-*"))
    assert json.loads(text)["name"] == "S1" and text.count("\n") > 3


def test_tables_given_as_functions_are_made_once(spark, db):
    made = []
    lazy = db.replace(marks=lambda: made.append(1) or db.marks)
    assert not made
    assert lazy.marks is lazy.marks and made == [1]
    with pytest.raises(AttributeError):
        lazy.grades
    with pytest.raises(ValueError, match="users"):
        Gradebook(marks=db.marks)


def test_timestamps_are_kept(db):
    assert rows(db.courses, "created_at") == [(T0,)]


class Database:
    """Answers the statements of a JDBC reader from SQLite; each predicate is one partition."""

    def __init__(self, spark, tables):
        self.spark, self.connection, self.parts = spark, sqlite3.connect(":memory:"), {}
        for name, (columns, data) in tables.items():
            self.connection.execute(f"CREATE TABLE {name} ({', '.join(c.split()[0] for c in columns.split(', '))})")
            self.connection.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns.split(', ')))})", data)
        self.columns = {name: columns for name, (columns, _) in tables.items()}
        self.read = self

    def jdbc(self, url, table, predicates=None, properties=None):
        assert (url, properties) == ("jdbc:x", {"user": "u"})
        if predicates is None:
            return self.spark.createDataFrame(self.connection.execute(f"SELECT * FROM {table}").fetchall(), "low BIGINT")
        found = [self.connection.execute(f"SELECT * FROM {table} WHERE {p}").fetchall() for p in predicates]
        self.parts[table] = [len(part) for part in found]
        return self.spark.createDataFrame([r for part in found for r in part], self.columns[table])


def plain(schema):
    return schema.replace("TIMESTAMP_NTZ", "STRING")


def test_database_reads_are_split_evenly_and_leave_secrets_out(spark):
    """Ids of rows inserted as hashes lie far from the others; every partition has within twice the rows of any other."""
    r = random.Random(9)
    ids = [*range(1, 301), *[r.randrange(-2**63, 2**63) for _ in range(700)]]
    tables = {name: (plain(schema), []) for name, schema in TABLES.items()}
    tables["marks"] = (plain(TABLES["marks"]), [(i, 1, k, 5, None) for k, i in enumerate(ids)])
    tables["users"] = (plain(TABLES["users"]) + ", password STRING, nick STRING", [(1, "a", "e", "m", "p", "student", "secret", "n"), (None, "b", "e", "m", "p", "student", "secret", "n")])
    database = Database(spark, tables)
    db = load_jdbc(database, "jdbc:x", {"user": "u"}, partitions=8)
    assert db.users.columns == ["id", "name", "email", "matric_number", "program", "role", "nick"] and db.users.count() == 2
    assert len(database.parts["marks"]) == 8 and max(database.parts["marks"]) <= 2 * min(database.parts["marks"])
    assert sorted(r.id for r in db.marks.collect()) == sorted(ids)
    assert database.parts["courses"] == [0]
