"""The nine tables as one object, and how they are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType, StringType, StructField, StructType

from gradebook.sources.schema import TABLES

# A dimension of at most this many narrow rows may be broadcast (about 10 MB).
BROADCAST_ROWS = 100_000
# Columns that are never read.
SECRETS = {"password", "password_hash", "pin", "pin_hash", "salt", "secret", "token", "remember_token"}


class Gradebook:
    """The nine tables by name.

    A table may be given as a function; it is called when the table is first used.
    """

    users: DataFrame
    courses: DataFrame
    course_user: DataFrame
    assessments: DataFrame
    marks: DataFrame
    final_exams: DataFrame
    remark_requests: DataFrame
    notifications: DataFrame
    advisor_notes: DataFrame

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        if tables.keys() != TABLES.keys():
            raise ValueError(f"tables missing or unknown: {sorted(tables.keys() ^ TABLES.keys())}")
        self._tables = dict(tables)
        self._small: dict[str, bool] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    @property
    def spark(self) -> SparkSession:
        return self.users.sparkSession

    def replace(self, **tables: DataFrame) -> Gradebook:
        """A copy with some tables exchanged."""
        return Gradebook(**{**self._tables, **tables})

    def is_small(self, name: str) -> bool:
        """Whether a table holds at most BROADCAST_ROWS rows; counted once."""
        if name not in self._small:
            self._small[name] = has_at_most(getattr(self, name), BROADCAST_ROWS)
        return self._small[name]

    def dim(self, name: str, df: DataFrame | None = None) -> DataFrame:
        """A dimension for a join: broadcast if its row count was checked, else shuffled.

        ``df`` may be a projection or per-key summary of table ``name`` that has
        no more rows than the table itself.
        """
        side = getattr(self, name) if df is None else df
        return F.broadcast(side) if self.is_small(name) else side


def has_at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint only if it is shown to have few rows."""
    return F.broadcast(df) if has_at_most(df, rows) else df


def load(spark: SparkSession, directory: str) -> Gradebook:
    """Read the nine tables from ``directory/<table>`` Parquet, in the types they are stored in.

    The listed columns come first; a missing one is an error. Other stored columns follow, so that a table that is
    written again loses nothing, except for those named in ``SECRETS``, which are never read.
    """
    return Gradebook(**{name: _listed_first(name, schema, spark.read.parquet(f"{directory}/{name}")) for name, schema in TABLES.items()})


def _listed_first(name: str, schema: str, stored: DataFrame) -> DataFrame:
    listed = [part.split()[0] for part in schema.split(", ")]
    if missing := [c for c in listed if c not in stored.columns]:
        raise ValueError(f"{name} lacks {missing}")
    return stored.select(*listed, *[c for c in stored.columns if c not in listed and c.lower() not in SECRETS])


def load_jdbc(spark: SparkSession, url: str, properties: dict[str, str], partitions: int) -> Gradebook:
    """Read the nine tables from a database, each split on its id into ``partitions`` of about as many rows.

    Where ids are spread evenly, equal steps would do, but ids of inserted rows may be hashes. So the database is first asked for
    the ids at which each of ``partitions`` equal groups begins, and each partition reads one group. The listed
    columns come first, other stored columns follow, as in ``load``; those named in ``SECRETS`` are not fetched.
    """
    def table(name: str, schema: str) -> DataFrame:
        starts = spark.read.jdbc(url, _group_starts(name, partitions), properties=properties)
        lows = starts.agg(F.sort_array(F.collect_list(F.col("low").cast("bigint")))).first()[0]
        return _listed_first(name, schema, spark.read.jdbc(url, name, predicates=id_ranges(lows), properties=properties))

    return Gradebook(**{name: table(name, schema) for name, schema in TABLES.items()})


def _group_starts(name: str, groups: int) -> str:
    """The statement for the smallest id of each of ``groups`` equal groups of a table."""
    return (
        f"(SELECT MIN(id) AS low FROM (SELECT id, NTILE({groups}) OVER (ORDER BY id) AS part FROM {name} WHERE id IS NOT NULL) numbered"
        " GROUP BY part) starts")


def id_ranges(lows: list[int]) -> list[str]:
    """Conditions that between them hold for every row once, of which each begins at one of the sorted ids."""
    bounds = sorted(set(lows))[1:]
    if not bounds:
        return ["1 = 1"]
    return [f"id < {bounds[0]} OR id IS NULL", *[f"id >= {a} AND id < {b}" for a, b in zip(bounds, bounds[1:])], f"id >= {bounds[-1]}"]


def read_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Change records as JSON lines, each field read on its own; absent fields are NULL.

    A whole number may be given as 7, 7.0 or "7", any number also as a text, a text also as a
    number or a truth value. ``_rejected`` names the fields whose value does not fit, with the value, and is NULL if all do; the
    other fields of such a line are there. A line that is no JSON object keeps its text in ``_corrupt_record``. So
    the caller can reject lines with a reason instead of losing them, and apply the rest.
    """
    fields = StructType.fromDDL(schema).fields
    lines = spark.read.text(path).where(F.length(F.btrim("value")) > 0).withColumn("_line", F.try_parse_json("value"))
    readable = F.coalesce(F.schema_of_variant("_line").startswith("OBJECT"), F.lit(False))
    read = {f.name: _field(f) for f in fields}
    reasons = F.concat_ws("; ", *[reason for _, reason in read.values()])
    return lines.select(
        *[value.alias(name) for name, (value, _) in read.items()],
        F.when(readable & (reasons != ""), reasons).alias("_rejected"),
        F.when(~readable, F.col("value")).alias("_corrupt_record"))


def _field(field: StructField) -> tuple[Column, Column]:
    """The value of a field of the variant ``_line`` in its type, and why it cannot be read (NULL if it can)."""
    path = f"$.{field.name}"
    kind = F.schema_of_variant(F.try_variant_get("_line", path, "variant"))
    text = F.btrim(F.try_variant_get("_line", path, "string"))
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    wanted = field.dataType
    if isinstance(wanted, IntegralType):
        exact = text.try_cast("decimal(38,10)")
        value, usable, needs = exact.try_cast(wanted), (number | (kind == "STRING")) & (exact == F.floor(exact)), "a whole number"
    elif isinstance(wanted, NumericType):
        value = text.try_cast(wanted)
        usable, needs = (number | (kind == "STRING")) & (F.abs(value) < F.lit(float("inf"))), "a number"
    elif isinstance(wanted, StringType):
        value = F.try_variant_get("_line", path, "string")
        usable, needs = number | kind.isin("STRING", "BOOLEAN"), "a text"
    else:
        value, usable, needs = text.try_cast(wanted), kind == "STRING", "a time"
    given = kind.isNotNull() & (kind != "VOID")
    fits = F.coalesce(usable & value.isNotNull(), F.lit(False))
    shown = F.coalesce(F.to_json(F.try_variant_get("_line", path, "variant")), F.lit("?"))
    return F.when(given & fits, value), F.when(given & ~fits, F.concat(F.lit(f"{field.name} needs {needs}: "), shown))
