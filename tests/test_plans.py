"""Properties every registered plan must have."""

import re
from pathlib import Path

import pytest

from catalog.queries import QUERIES, tables
from gradebook.operators import facts
from gradebook.sources import tables as tables_module

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups", "FlatMapCoGroups")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python_in_the_plan(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not [word for word in FORBIDDEN if word in text]


def test_large_dimensions_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tables_module, "BROADCAST_ROWS", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        book = tables(spark, SF)
        fresh = book.replace()
        assert "BroadcastExchange" not in plan(facts.scored_marks(fresh))
        assert "SortMergeJoin" in plan(facts.scored_marks(fresh))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_dimensions_are_broadcast_and_marks_not_shuffled(spark):
    text = plan(facts.scored_marks(tables(spark, SF)))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_facts_need_one_shuffle(spark):
    book = tables(spark, SF)
    text = plan(facts.course_facts(book, remarks=True))
    assert len(re.findall("Exchange hashpartitioning", text)) == 1 and "SortMergeJoin" not in text


def test_unused_columns_are_not_read(spark):
    text = plan(QUERIES["cgpa_distribution"](spark, SF))
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert sorted(part.split(":")[0] for part in read.split(",")) == ["gpa", "student_id"]


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)]" in plan(QUERIES["note_feed"](spark, SF))


def test_lineage_is_never_cut_on_one_machine():
    """The record library gathers no rows either, but the names of the files to read; what the text operators gather is tested with them."""
    files = [path for folder in ("gradebook", "catalog") for path in (ROOT / folder).rglob("*.py") if "llm" not in path.parts]
    sources = {path.name: path.read_text() for path in files}
    assert not any("localCheckpoint" in text or ".toPandas(" in text for text in sources.values())
    assert {name: text.count(".collect()") for name, text in sources.items() if ".collect()" in text} == {"versions.py": 1}
