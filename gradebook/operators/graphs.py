"""Connected components as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.sources.checkpoints import written_once


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v): root is the smallest node of its component.

    Labels travel to neighbours and are then replaced by their own label (pointer
    jumping), so that long chains shrink by half each time. Only minima are
    gathered per node, never lists of neighbours. Null ends are ignored.
    """
    # Written tables, as a checkpoint computes its rows twice and is read in as many tasks as wrote it, however few the rows.
    both = written_once(
        edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        .where("u IS NOT NULL AND v IS NOT NULL").distinct(), "edges")
    labels = written_once(both.groupBy("u").agg(F.least("u", F.min("v")).alias("root")).select(F.col("u").alias("node"), "root"), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), "root"), "v")
            .groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        after = written_once(lower.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("root")), "labels")
        changed = after.where("root <> old").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels
