"""Results stay whole when one course, one student and one user own a third of the rows."""

import duckdb
import pytest
from compare import differences, oracle_connection

from catalog.oracle import ORACLE
from catalog.queries import QUERIES

SOURCE = "/root/testdata/sf0.001"
SKEWED = {
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey) FROM '{file}'",
    "lineitem": "SELECT * REPLACE (CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 77 ELSE l_partkey END AS l_partkey) FROM '{file}'",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 8 ELSE user_id END AS user_id) FROM '{file}'",
}
NAMES = [
    "course_rankings", "rank_card", "rankings_report_entries", "progress_lecturer", "recent_notifications",
    "recent_notes", "student_dashboard_entries", "student_totals", "insert_unique_remarks", "upsert_marks",
    "insert_ignore_enrolments", "record_finals", "weight_check", "what_if_totals", "students_by_course",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for table in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        file = f"{SOURCE}/{table}.parquet"
        rows = SKEWED.get(table, "SELECT * FROM '{file}'").format(file=file)
        duckdb.sql(f"COPY ({rows}) TO '{folder}/{table}.parquet' (FORMAT PARQUET)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_oracle_under_skew(spark, skewed, name):
    assert differences(QUERIES[name](spark, skewed), oracle_connection(skewed), ORACLE[name]) is None
