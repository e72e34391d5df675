"""Tables laid out by person, so that listings join without moving rows, and pages of listings.

Users and the rows that belong to them are stored in as many buckets, by the hash of the person's id, and sorted by it. A
join or aggregation by person then reads matching buckets and needs no exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.sources.schema import TABLES
from gradebook.sources.tables import Gradebook

#: The column that names the person a row belongs to; courses and assessments belong to none.
PERSON = {
    "users": "id", "course_user": "user_id", "marks": "student_id", "final_exams": "student_id", "remark_requests": "student_id",
    "notifications": "user_id", "advisor_notes": "student_id",
}


def store_by_person(db: Gradebook, database: str, buckets: int) -> None:
    """Write all tables of ``db`` to a new ``database`` of the session's catalog.

    ``buckets`` should make buckets of some hundred MB of the largest table. A task writes whole buckets, one file each; a
    person with very many rows is in one bucket, so feeds of such a person are better read from the plain tables.
    """
    spark = db.spark
    spark.sql(f"CREATE DATABASE {database}")
    for name in TABLES:
        table = getattr(db, name)
        if (person := PERSON.get(name)) is None:
            table.write.saveAsTable(f"{database}.{name}")
        else:
            table.repartition(buckets, person).write.bucketBy(buckets, person).sortBy(person).saveAsTable(f"{database}.{name}")


def load_by_person(spark: SparkSession, database: str) -> Gradebook:
    """The tables that ``store_by_person`` wrote."""
    return Gradebook(**{name: spark.table(f"{database}.{name}") for name in TABLES})


def page(rows: DataFrame, order: Sequence[tuple[str, str]], n: int, after: Mapping[str, object] | None = None) -> DataFrame:
    """The first ``n`` rows of a listing that come after the row ``after``, or from the start.

    ``order`` names columns with "asc" or "desc" and ends in a unique one; NULL comes first or last, as Spark
    sorts. ``after`` holds the last row's values of these columns. As pages begin after a row and not at a number, rows that are added or
    removed in between neither repeat nor hide others. Each task keeps ``n`` rows only.
    """
    sort = [F.col(c).asc() if way == "asc" else F.col(c).desc() for c, way in order]
    if after is not None:
        rows = rows.where(_after(rows, order, after))
    return rows.orderBy(*sort).limit(n)


def _after(rows: DataFrame, order: Sequence[tuple[str, str]], after: Mapping[str, object]) -> Column:
    """Whether a row comes later in the order: at the first column that differs."""
    ways, same = [], F.lit(True)
    for name, way in order:
        column, value = F.col(name), F.lit(after[name]).cast(rows.schema[name].dataType)
        if after[name] is None:
            later = column.isNotNull() if way == "asc" else F.lit(False)
        else:
            later = column > value if way == "asc" else column.isNull() | (column < value)
        ways.append(same & F.coalesce(later, F.lit(False)))
        same = same & column.eqNullSafe(value)
    return reduce(lambda a, b: a | b, ways)
