"""Queries that apply the operators of this package to the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.llm.chat import chat_messages
from gradebook.llm.decontaminate import contamination
from gradebook.llm.hard_negatives import hard_negatives
from gradebook.llm.licences import licences
from gradebook.llm.mixing import mixed_copies
from gradebook.llm.near_duplicates import near_duplicates
from gradebook.llm.near_vectors import near_vectors
from gradebook.llm.periodic_runs import periodic_runs
from gradebook.llm.quality_rules import quality
from gradebook.llm.site_quality import site_quality
from gradebook.llm.substrings import repeated_substrings
from gradebook.llm.surrogates import with_surrogates
from gradebook.llm.url_filters import Rule, judged_urls, labelled_urls, split_url
from gradebook.llm.workers import ship

# The rules of the URL query, and how many pages of good documents it learns from.
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
GOOD_URLS = 200

#: The key of the query and of the pipeline. In use, pass a secret one.
SURROGATE_KEY = "not a secret"


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_licences(spark: SparkSession, directory: str) -> DataFrame:
    """Documents lie at source/lang/doc_id.txt."""
    docs = _table(spark, directory, "documents")
    files = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("path"), "text")
    found = licences(files)
    number = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("bigint")
    return found.select(number.alias("doc_id"), "path", "licence", "cosine", "origin", "licence_dir")


def op2_site_quality(spark: SparkSession, directory: str) -> DataFrame:
    """A document's host is its source, the path below it its language."""
    return site_quality(_table(spark, directory, "documents"), _table(spark, directory, "labels"))


def op3_chat(spark: SparkSession, directory: str) -> DataFrame:
    """Users' turns are calls of one tool, each after the one before; assistants' turns are the results of the turn before."""
    turns = _table(spark, directory, "conversations")
    name = lambda back: F.concat(F.lit("c"), F.col("turn") - back)
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    messages = turns.select(
        "conv_id", "turn", "role", F.when(~user | F.col("role").isNull(), F.col("text")).alias("text"),
        F.when(user, name(0)).when(assistant, name(1)).alias("call_id"), F.when(user, F.lit("answer")).alias("tool"),
        F.when(user, F.to_json(F.struct("text", "turn"))).alias("arguments"),
        F.when(user & (F.col("turn") >= 2), name(2)).alias("after"))
    return chat_messages(messages, {"answer": {"text": ("string", True), "turn": ("integer", True)}})


def op4_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    found = contamination(_table(spark, directory, "documents"), _table(spark, directory, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated")


def op5_suffixes(spark: SparkSession, directory: str) -> DataFrame:
    found = repeated_substrings(_table(spark, directory, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op6_urls(spark: SparkSession, directory: str) -> DataFrame:
    """Labelled are the fixed small table and pages of documents labelled good (a bounded sample by hash)."""
    pages = _table(spark, directory, "pages")
    number = F.regexp_extract(split_url(F.col("url"))[1], r"/([0-9]{1,18})(?:[^0-9]|$)", 1)
    good = (
        pages.select("url", number.try_cast("bigint").alias("doc_id"))
        .join(_table(spark, directory, "labels").where("quality = 1 AND toxic = 0").select("doc_id").distinct(), "doc_id")
        .orderBy(F.xxhash64("url"), "url").limit(GOOD_URLS).select("url", F.lit(0).alias("blocked")))
    found = judged_urls(pages, labelled_urls(spark).unionByName(good), rules=URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def op7_quality(spark: SparkSession, directory: str) -> DataFrame:
    found = quality(_table(spark, directory, "documents"), keep=["doc_id"], into="q")
    return found.select(
        "doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "q.kept")


def op8_mixing(spark: SparkSession, directory: str) -> DataFrame:
    found = mixed_copies(_table(spark, directory, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op9_surrogates(spark: SparkSession, directory: str) -> DataFrame:
    docs = _table(spark, directory, "documents").select("doc_id", "text")
    return with_surrogates(docs, key=SURROGATE_KEY, count_col="n_entities")


def op10_minhash(spark: SparkSession, directory: str) -> DataFrame:
    found = near_duplicates(_table(spark, directory, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_hard_negatives(spark: SparkSession, directory: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; labels of every seventh row are moved on by one."""
    rows = _table(spark, directory, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint")
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document by checksum the words from one on repeat with a period."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(checksum / 10).cast("bigint")

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        period = F.slice(words, a + 1, p)
        copies = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(copies, F.lit(1), n - a)), " ")

    # The list of words is bound to a name once: transform() over a list of one.
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when(checksum % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, directory: str) -> DataFrame:
    found = periodic_runs(with_periodic_tails(_table(spark, directory, "documents")))
    line = lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_near_vectors(spark: SparkSession, directory: str) -> DataFrame:
    return near_vectors(_table(spark, directory, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licences": op1_licences,
    "op2_site_quality": op2_site_quality,
    "op3_chat": op3_chat,
    "op4_decontaminate": op4_decontaminate,
    "op5_suffixes": op5_suffixes,
    "op6_urls": op6_urls,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_surrogates": op9_surrogates,
    "op10_minhash": op10_minhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_runs": op12_runs,
    "op13_near_vectors": op13_near_vectors,
}
