"""Batches of changes applied to a table.

Each function is pure: (base, changes) -> new base. Changes carry ``seq``, their
order of arrival, and are first reduced per key and written once to the checkpoint folder. A batch that is shown to be
small is broadcast, so the table is not shuffled; a larger one meets the table
in a single shuffle on the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from gradebook.operators.joins import already_present
from gradebook.operators.keyed import first_per_key, last_per_key
from gradebook.sources.checkpoints import written_once
from gradebook.sources.tables import BROADCAST_ROWS, checked_broadcast, has_at_most

# Reasons of rejected changes.
UNREADABLE = "Line cannot be read."
REPEATED = "seq is repeated."


def row_id(*parts: Column) -> Column:
    """Id of a new row, from its natural key."""
    return F.xxhash64(*parts)


def stored_as(value: Column, given: DataType, wanted: DataType, name: str) -> Column:
    """``value`` in the type of the table's column; a value that the type cannot hold stops the job."""
    if given == wanted:
        return value
    cast = value.cast(wanted)
    lost = F.raise_error(F.concat(F.lit(f"{name} cannot hold "), value.cast("string")))
    same = cast.cast(given) == value
    return F.when(value.isNull(), F.lit(None).cast(wanted)).when(same, cast).otherwise(lost.cast(wanted))


def append(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Add rows in the base's types; columns they lack become NULL, columns the base lacks are left out."""
    given = rows.schema
    kept = [
        stored_as(F.col(f.name), given[f.name].dataType, f.dataType, f.name).alias(f.name)
        for f in base.schema if f.name in rows.columns]
    return base.unionByName(rows.select(*kept), allowMissingColumns=True)


def validated(batch: DataFrame, keys: Sequence[str], base: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The usable changes of a batch, and the others with a reason.

    Not usable are lines that could not be read, as a whole or in a field, changes that lack a key or ``seq``, with ``base``
    also changes of which a column of that table cannot hold a value, and all changes that
    share a ``seq``, as their order is unknown.
    """
    reason = F.when(F.col("_corrupt_record").isNotNull() if "_corrupt_record" in batch.columns else F.lit(False), UNREADABLE)
    if "_rejected" in batch.columns:
        reason = reason.when(F.col("_rejected").isNotNull(), F.col("_rejected"))
    for name in ["seq", *keys]:
        reason = reason.when(F.col(name).isNull(), f"{name} is required")
    for f in base.schema if base is not None else []:
        if f.name in batch.columns and batch.schema[f.name].dataType != f.dataType:
            lost = F.concat(F.lit(f"{f.name} cannot hold "), F.col(f.name).cast("string"))
            reason = reason.when(~_holds(F.col(f.name), batch.schema[f.name].dataType, f.dataType), lost)
    repeated = batch.groupBy("seq").agg(F.count("*").alias("_times")).where("_times > 1").select("seq", F.lit(True).alias("_repeated"))
    marked = batch.join(repeated, "seq", "left").withColumn("reason", reason.when(F.col("_repeated"), REPEATED)).drop("_repeated")
    columns = [c for c in batch.columns if c not in {"_corrupt_record", "_rejected"}]
    return marked.where("reason IS NULL").select(*columns), marked.where("reason IS NOT NULL").select(*batch.columns, "reason")


def _holds(value: Column, given: DataType, wanted: DataType) -> Column:
    """Whether the type can hold the value; NULL fits everywhere."""
    return value.isNull() | F.coalesce(value.try_cast(wanted).try_cast(given) == value, F.lit(False))


def _once(changes: DataFrame) -> DataFrame:
    """A reduced batch, written so that measuring it and every join read the result and not the batch again."""
    return written_once(changes, "batch")


def _with_values(rows: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    return rows.withColumns(dict(values)) if values else rows


def _taken_over(base: DataFrame, values: Mapping[str, Column], hit: str = "_hit") -> list[Column]:
    """The base's columns, those in ``values`` from the change where there is one; NULLs overwrite too."""
    return [
        F.when(F.col(hit), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in base.columns
    ]


def _as_hits(base: DataFrame, latest: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    new = latest.select(*keys, *[value.alias(f"_new_{name}") for name, value in values.items()])
    return new.select(*keys, F.lit(True).alias("_hit"), *[
        stored_as(F.col(f"_new_{c}"), new.schema[f"_new_{c}"].dataType, base.schema[c].dataType, c).alias(f"_new_{c}") for c in values])


def update(
    base: DataFrame, changes: DataFrame, key: str | Sequence[str], columns: Sequence[str], stamps: Mapping[str, Column] | None = None
) -> DataFrame:
    """Overwrite ``columns`` of the rows whose key is in the batch; ``stamps`` are set there if the base has the column."""
    keys = [key] if isinstance(key, str) else list(key)
    latest = _once(last_per_key(changes.select("seq", *keys, *columns), keys))
    values = {**{c: F.col(c) for c in columns}, **{c: v for c, v in (stamps or {}).items() if c in base.columns}}
    hits = checked_broadcast(_as_hits(base, latest, keys, values))
    return base.join(hits, keys, "left").select(*_taken_over(base, values))


def upsert(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    defaults: Mapping[str, Column] | None = None,
    stamps: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Set ``columns`` where the key exists, insert the row where it does not.

    ``defaults`` fill other columns of inserted rows; ``stamps`` are set on both
    when the base has the column.
    """
    keys = list(keys)
    stamps = {c: v for c, v in (stamps or {}).items() if c in base.columns}
    latest = _once(last_per_key(changes.select("seq", *keys, *columns), keys))
    values = {**{c: F.col(c) for c in columns}, **stamps}
    inserts = {**(defaults or {}), **stamps}
    hits = _as_hits(base, latest, keys, values)
    if has_at_most(latest, BROADCAST_ROWS):
        updated = base.join(F.broadcast(hits), keys, "left").select(*_taken_over(base, values))
        _, fresh = already_present(latest, base, keys, small=True)
        return append(updated, _with_values(fresh, inserts))
    both = base.withColumn("_stored", F.lit(True)).join(hits, keys, "full")
    fresh_columns = {
        c: F.when(F.col("_stored").isNull(), v).otherwise(F.col(c))
        for c, v in inserts.items() if c in base.columns and c not in values}
    return both.withColumns(fresh_columns).select(*_taken_over(base, values))


def insert_ignore(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], defaults: Mapping[str, Column] | None = None
) -> DataFrame:
    """Insert the first change of each key that does not exist yet."""
    first = _once(first_per_key(changes, list(keys), [F.asc("seq")]))
    _, fresh = already_present(first, base, list(keys))
    return append(base, _with_values(fresh, defaults or {}))


def insert_unique(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    reason: str,
    defaults: Mapping[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Insert each key once; every other change of the key is rejected with ``reason``.

    The winner of a key is found by a minimum, which combines before the shuffle,
    and rows are then matched on (key, seq), so a hot key is never gathered.
    """
    keys = list(keys)
    changes = _once(changes)
    winners = changes.groupBy(*keys).agg(F.min("seq").alias("seq"))
    _, fresh = already_present(winners, base, keys)
    accepted = changes.join(fresh, [*keys, "seq"], "left_semi")
    rejected = changes.join(fresh, [*keys, "seq"], "left_anti").withColumn("reason", F.lit(reason))
    return append(base, _with_values(accepted, defaults or {})), rejected


def delete(base: DataFrame, requests: DataFrame, keys: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Remove the rows whose key is requested; also report per requested key whether a row matched."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    wanted = _once(requests.select(*keys).distinct())
    side = checked_broadcast(wanted)
    found = base.select(*keys).join(side, keys, "left_semi").distinct().withColumn("_found", F.lit(True))
    outcome = wanted.join(found, keys, "left").select(*keys, F.col("_found").isNotNull().alias("success"))
    return base.join(side, keys, "left_anti").select(*base.columns), outcome
