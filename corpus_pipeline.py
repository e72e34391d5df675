"""The corpus pipeline: five stages over ``documents``, each written as Parquet before the next.

Every stage works on all that its predecessor kept. All but the last return the columns of
documents; the last returns each document as often as the mix takes it, with its ``copy``. Nulls, empty texts, ties and
repeated rows are treated as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.llm.decontaminate import without_contaminated
from gradebook.llm.mixing import mixed
from gradebook.llm.near_duplicates import without_near_duplicates
from gradebook.llm.quality_rules import passing_quality
from gradebook.llm.queries import SURROGATE_KEY
from gradebook.llm.surrogates import with_surrogates
from gradebook.llm.workers import ship
from gradebook.sources.checkpoints import kept_table, passing_tables, remove_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return passing_quality(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity from 0.8) the document of the smallest id stays."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by surrogates; n_chars is that of the new text.

    The key is the session's setting ``gradebook.surrogates.key``, which has to be kept secret, and a known one without it.
    """
    columns = docs.columns
    return with_surrogates(docs, key=spark.conf.get("gradebook.surrogates.key", SURROGATE_KEY)).withColumn("n_chars", F.length("text").cast("bigint")).select(*columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("PII", privacy),
    ("mixing sources to target weights", mixing),
]

#: Components and Newton steps have no plain SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to all documents.

    What a stage writes on its way is removed when its result is written, and that when the next stage's is.
    """
    ship(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with passing_tables(spark):
            out = kept_table(stage(spark, docs, sf_dir), "documents")
        if before is not None:
            remove_table(before)
        docs = before = out
    return docs
