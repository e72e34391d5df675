"""What the steps of loops and the bitmaps cost the driver."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from gradebook.llm.bitmaps import BITS, bitmap, passes
from gradebook.llm.mixing import _solved
from gradebook.operators.graphs import components


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_are_read_from_a_written_table(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, None)], "u bigint, v bigint")
    found = components(edges)
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert "FileScan parquet" in plan(found) and "ExistingRDD" not in plan(found)
    assert not components(edges.where("u > 9")).count()


def test_the_state_of_the_rates_is_read_from_a_written_table(spark):
    counts = spark.createDataFrame(
        [(0, 10, 3, 10.0, 130, 100.0), (0, 20, 5, 20.0, 130, 100.0), (1, 5, 4, 5.0, 20, 35.0)],
        "place int, class bigint, n bigint, x double, source_size bigint, target double")
    solved = _solved(counts, 2)
    assert "ExistingRDD" not in plan(solved)
    rated = counts.join(solved, "place").withColumn("rate", F.least(F.lit(2.0), F.exp(F.col("step") * F.col("x") / F.col("mean"))))
    sums = rated.groupBy("place").agg(F.sum(F.expr("n * x * rate")).alias("f"), F.first("target").alias("target")).collect()
    assert len(sums) == 2 and all(abs(r.f - r.target) < 1e-5 * r.target for r in sums)


def test_a_full_bitmap_takes_little_memory(spark):
    hashes = spark.range(BITS // 64).select((F.col("id") * 64 + F.col("id") % 64).alias("hash"))
    tracemalloc.start()
    try:
        bits = bitmap(hashes)
        assert tracemalloc.get_traced_memory()[1] < 16_000_000
    finally:
        tracemalloc.stop()
    asked = np.arange(0, BITS, 7, dtype=np.uint64)
    assert (passes(bits, asked) == (asked % np.uint64(64) == asked // np.uint64(64) % np.uint64(64))).all()
    assert not bitmap(hashes.where("hash < 0")).any()
