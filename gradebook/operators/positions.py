"""Row numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradebook.sources.checkpoints import written_once
from gradebook.sources.tables import checked_broadcast


def number_within(df: DataFrame, group: str, order: Sequence[Column], position: str) -> DataFrame:
    """``row_number() over (partition by group order by order)`` without one task per group.

    ``order`` must end in a column that is unique inside the group. The rows are
    range-partitioned on (group, order), so a group of any size spreads over many
    tasks, and sorted. Each task's block of a group is numbered by its place in
    the task; adding the sizes of the group's earlier blocks gives the final
    number. The placed rows are written once because block sizes and row places
    must come from the same partitioning, also after a task is run again.
    """
    keys = [F.col(group), *order]
    placed = written_once(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_task", F.shiftright("_place", 33)), "placed")
    blocks = placed.groupBy(group, "_task").agg(F.min("_place").alias("_first"), F.count("*").alias("_size"))
    earlier = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = written_once(blocks.select(
        group, "_task",
        (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")), "shifts")
    return (
        placed.join(checked_broadcast(shifts), [group, "_task"])
        .withColumn(position, F.col("_place") + F.col("_shift"))
        .drop("_place", "_task", "_shift")
    )


def running_total_within(df: DataFrame, group: str, order: Sequence[Column], value: Column, total: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to and with each row, without one task per group.

    As in ``number_within`` a group's sorted rows are spread over tasks; each task sums its
    block, and the sums of earlier blocks are added.
    """
    keys = [F.col(group), *order]
    placed = written_once(
        df.withColumn("_value", value).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_task", F.shiftright("_place", 33)), "placed")
    blocks = placed.groupBy(group, "_task").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = written_once(blocks.select(group, "_task", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")), "before")
    inside = Window.partitionBy(group, "_task").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(checked_broadcast(before), [group, "_task"])
        .withColumn(total, F.sum("_value").over(inside) + F.col("_before"))
        .drop("_place", "_task", "_value", "_before"))
