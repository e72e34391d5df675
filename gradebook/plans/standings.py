"""Stored rankings that follow batches: the rows of a course in order of total, in blocks whose sizes are known.

The table is versioned and in the order of (course, total from the highest, student), so its manifest holds the number of rows of every
block. A rank is the number of rows of the course in earlier blocks plus the place inside the row's own block. A new total moves one
row between two blocks; the ranks of all rows between them change with it, but none of those rows is read or written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradebook.operators.positions import running_total_within
from gradebook.sources.checkpoints import written_once
from gradebook.sources.tables import checked_broadcast
from gradebook.sources.versions import VersionedTable

KEYS = ["course_id", "below", "student_id"]


class Standings:
    """Rankings of totals, which are frames of course_id, student_id and total_points; a pair has one total."""

    def __init__(self, spark: SparkSession, root: str, **options) -> None:
        self.table = VersionedTable(spark, root, **options)

    @classmethod
    def create(cls, totals: DataFrame, root: str, **options) -> Standings:
        VersionedTable.create(_keyed(totals), root, KEYS, **options)
        return cls(totals.sparkSession, root, **options)

    def move(self, before: DataFrame, after: DataFrame) -> int:
        """Take out the totals ``before`` and put in the totals ``after``; a total on both sides stays as it is."""
        signed = _keyed(before).withColumn("sign", F.lit(-1)).unionByName(_keyed(after).withColumn("sign", F.lit(1)))
        moves = written_once(signed.groupBy(*KEYS).agg(F.sum("sign").alias("sign")).where("sign <> 0"), "moves")
        if moves.isEmpty():
            return self.table.commit().version

        def moved(stored: DataFrame, changes: DataFrame) -> DataFrame:
            gone = checked_broadcast(changes.where("sign < 0").select(*KEYS))
            return stored.join(gone, KEYS, "left_anti").select(*stored.columns).unionByName(
                changes.where("sign > 0").select(*KEYS), allowMissingColumns=True)

        return self.table.rewrite(moves, moved)

    def ranks(self, totals: DataFrame) -> DataFrame:
        """(course_id, student_id, rank) of the given totals; of none that is not stored.

        Read are the blocks of the totals and, per course, the block in which it begins beside another course.
        """
        asked = written_once(_keyed(totals).distinct(), "asked")
        courses = checked_broadcast(asked.select("course_id").distinct())
        blocks = self.table.manifest().select("_file", "low", "vectors", F.col("low.course_id").alias("course_id"), F.col("high.course_id").alias("last"), "rows")
        shared = blocks.where("course_id <> last").join(courses.withColumnRenamed("course_id", "last"), "last", "left_semi")
        own = self.table.files_of(asked).select("_file", "vectors")
        read = written_once(own.unionByName(shared.select("_file", "vectors")).distinct(), "read")
        rows = self.table.rows_of(read).join(courses, "course_id", "left_semi")
        inside = Window.partitionBy("_file", "course_id").orderBy("below", "student_id")
        placed = written_once(rows.withColumn("place", F.row_number().over(inside)), "placed")

        # Blocks of one course count by the manifest, those of several by what was read.
        counted = placed.groupBy("_file", "course_id").agg(F.count("*").alias("rows"), F.min(F.struct(*KEYS)).alias("low"))
        several = counted.join(checked_broadcast(blocks.where("course_id <> last").select("_file")), "_file", "left_semi")
        single = blocks.where("course_id = last").join(courses, "course_id", "left_semi").select("_file", "course_id", "rows", "low")
        earlier = running_total_within(single.unionByName(several), "course_id", [F.col("low")], F.col("rows"), "upto")
        offsets = earlier.select("_file", "course_id", (F.col("upto") - F.col("rows")).alias("offset"))
        return (
            placed.join(asked, KEYS, "left_semi").join(checked_broadcast(offsets), ["_file", "course_id"])
            .select("course_id", "student_id", (F.col("offset") + F.col("place")).alias("rank")))


def _keyed(totals: DataFrame) -> DataFrame:
    return totals.select("course_id", (-F.col("total_points")).alias("below"), "student_id")
