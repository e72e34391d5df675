"""The line summary on literal rows: its values, and that a pair's lines come together in one narrow shuffle."""

from datetime import datetime

from books import rows

from gradebook.sources.star import _line_summary

DAY = datetime(2024, 1, 1)


def tables(spark):
    lines = [(1, 10, 3, 1, 20.0, "N", DAY), (1, 10, 4, 1, 30.0, "A", DAY.replace(day=2)), (1, 11, 5, 2, 7.0, "R", DAY), (2, 10, 3, 1, 9.0, "N", DAY), (3, 10, 3, 1, 9.0, "N", DAY), (9, 10, 3, 1, 9.0, "N", DAY), (1, 99, 3, 1, 9.0, "N", DAY)]
    lineitem = spark.createDataFrame(lines, "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP")
    orders = spark.createDataFrame([(1, 4), (2, 4), (3, 39)], "o_orderkey BIGINT, o_custkey BIGINT")
    part = spark.createDataFrame([(10, "Brand#11"), (11, "Brand#12")], "p_partkey BIGINT, p_brand STRING")
    return lineitem, orders, part


def test_values(spark):
    summary = _line_summary(*tables(spark)).select("student_id", "course_id", "k", "mark_obtained", "mix")
    assert rows(summary) == [(5, 11, 1, 40, 3 * 130 + 7 * (3 + 4 + 3)), (5, 12, 2, 7, 143 + 35)]


def test_a_pair_lies_together(spark):
    plan = _line_summary(*tables(spark))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(student_id#" in plan and not any(
        "hashpartitioning(student_id" in line and ", k#" in line.split("hashpartitioning", 1)[1].split(")", 1)[0] for line in plan.splitlines())
    # Columns that only make up others are gone before the first shuffle.
    assert not any("Exchange" not in line and "Join" in line and "l_suppkey" in line for line in plan.splitlines())
