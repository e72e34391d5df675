"""Keys and references of all tables checked in one pass."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.sources.tables import Gradebook


class Reference(NamedTuple):
    """``column`` of ``table`` names an id of ``parent``; it may be NULL if it is optional."""

    table: str
    column: str
    parent: str
    optional: bool = False


class Key(NamedTuple):
    """One or two columns of ``table`` that no two rows share."""

    table: str
    columns: tuple[str, ...]


REFERENCES = [
    Reference("course_user", "user_id", "users"),
    Reference("course_user", "course_id", "courses"),
    Reference("assessments", "course_id", "courses"),
    Reference("marks", "assessment_id", "assessments"),
    Reference("marks", "student_id", "users"),
    Reference("final_exams", "course_id", "courses"),
    Reference("final_exams", "student_id", "users"),
    Reference("remark_requests", "student_id", "users"),
    Reference("remark_requests", "assessment_id", "assessments"),
    Reference("notifications", "user_id", "users"),
    Reference("advisor_notes", "advisor_id", "users"),
    Reference("advisor_notes", "student_id", "users"),
    Reference("advisor_notes", "course_id", "courses", optional=True),
]

UNIQUE = [
    *[Key(t, ("id",)) for t in (
        "users", "courses", "course_user", "assessments", "marks", "final_exams", "remark_requests", "notifications", "advisor_notes")],
    Key("course_user", ("user_id", "course_id")),
    Key("marks", ("assessment_id", "student_id")),
    Key("final_exams", ("course_id", "student_id")),
    Key("remark_requests", ("student_id", "assessment_id")),
]


def key_audit(db: Gradebook, unique: list[Key] = UNIQUE, references: list[Reference] = REFERENCES) -> DataFrame:
    """Every broken key or reference: table, rule, the value or pair of values, its number of rows, the smallest id among them.

    Rules are "<columns> is repeated", "<column> is required" and "<column> is not in <parent>". A key
    with a NULL is not repeated. The rows of all tables are reduced to the values that the rules are about and meet in
    one aggregation, by value: a reference meets the ids of its parent there, and a value that many rows share is
    counted before the shuffle. Rules about the same values share a space and have a place each in it, so a shuffled row is as wide as the
    space with the most rules, not as all rules together.
    """
    spaces: dict[tuple[str, tuple[str, ...]], list[Key | Reference]] = {}
    for key in unique:
        spaces.setdefault((key.table, key.columns), []).append(key)
    for reference in references:
        if (parent := (reference.parent, ("id",))) not in spaces:
            raise ValueError(f"the ids of {reference.parent} are not among the keys")
        spaces[parent].append(reference)
    parts = []
    for space, rules in enumerate(spaces.values()):
        for place, rule in enumerate(rules):
            rows = getattr(db, rule.table)
            columns = rule.columns if isinstance(rule, Key) else (rule.column,)
            if isinstance(rule, Key):
                rows = rows.dropna(subset=list(columns))
            elif rule.optional:
                rows = rows.where(F.col(rule.column).isNotNull())
            second = F.col(columns[1]) if len(columns) > 1 else F.lit(None)
            # The least of the ids that equal a value is the value.
            least = F.lit(None) if columns == ("id",) else F.col("id")
            parts.append(rows.select(
                F.lit(space).alias("space"), F.col(columns[0]).cast("bigint").alias("value"), second.cast("bigint").alias("second_value"),
                F.lit(place).alias("place"), least.cast("bigint").alias("id")))
    stacked = reduce(DataFrame.unionByName, parts)
    places = range(max(map(len, spaces.values())))
    mine = lambda n: F.col("place") == n
    counts = [F.count(F.when(mine(n), 1)).alias(f"rows_{n}") for n in places]
    least = [F.min(F.when(mine(n), F.col("id"))).alias(f"least_{n}") for n in places]
    met = stacked.groupBy("space", "value", "second_value").agg(*counts, *least)

    def broken(space: int, n: int, rule: Key | Reference) -> Column:
        rows, id_ = F.col(f"rows_{n}"), F.col(f"least_{n}")
        if isinstance(rule, Key):
            bad, text = rows > 1, F.lit(f"{', '.join(rule.columns)} is repeated")
            id_ = F.col("value") if rule.columns == ("id",) else id_
        else:
            bad = (rows > 0) & (F.col("value").isNull() | (F.col("rows_0") == 0))
            text = F.when(F.col("value").isNull(), f"{rule.column} is required").otherwise(f"{rule.column} is not in {rule.parent}")
        return F.when((F.col("space") == space) & bad, F.struct(F.lit(rule.table).alias("table_name"), text.alias("rule"), rows.alias("n_rows"), id_.alias("least_id")))

    found = F.filter(F.array(*[broken(s, n, rule) for s, rules in enumerate(spaces.values()) for n, rule in enumerate(rules)]), lambda x: x.isNotNull())
    # A value of one row that is an id or a key breaks no rule, which most are.
    suspect = met.where(reduce(lambda a, b: a | b, [F.col(f"rows_{n}") > 1 for n in places]) | (F.col("rows_0") == 0) | F.col("value").isNull())
    return suspect.select("value", "second_value", F.inline(found)).select("table_name", "rule", "value", "second_value", "n_rows", "least_id")
