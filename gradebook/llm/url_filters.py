"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.sources.checkpoints import written_once


class Rule(NamedTuple):
    """``verdict`` for a host with its subdomains and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str


#: Buckets of the hashed n-grams, and steps of the training.
BUCKETS = 2048
STEPS = 24

# Words of hosts for the small labelled table. Every word makes four URLs.
BLOCK_WORDS = [
    "casino", "poker", "bets", "betting", "slots", "jackpot", "win", "lottery", "pills", "pharma", "viagra", "cheap",
    "adult", "xxx", "porn", "sex", "cams", "escort", "spam", "farm", "free", "loans", "crypto-win", "replica",
]
ALLOW_WORDS = [
    "library", "museum", "university", "school", "news", "daily", "times", "gazette", "journal", "science", "history", "garden",
    "cooking", "travel", "weather", "city", "council", "health", "music", "theatre", "docs", "wiki", "forum", "archive",
]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): the small labelled table, made of the two word lists."""
    rows = []
    for blocked, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)):
        for i, word in enumerate(words):
            other = words[(i + 7) % len(words)]
            rows += [(f"https://{word}.example.net/en/{i}", blocked), (f"http://www.{word}-{other}.example.com/fr/{i}.html", blocked),
                     (f"https://m.{other}{word}.example.org/de/{i}", blocked), (f"http://blog.{word}-x.example.com/es/{i}?page=2", blocked)]
    return spark.createDataFrame(rows, "url string, blocked int")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) of the part after the first ``://``; both empty without one."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s).*?://", "")), F.lit(""))
    lower = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. ``rules`` is a list of the caller's, tried one by one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the 3- and 4-grams of host and path."""
    def grams(text: Column, n: int, seed: str) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(seed), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    ends = lambda c: F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(F.concat(*[grams(ends(c), n, f"{part}{n}") for part, c in (("h", host), ("p", path)) for n in (3, 4)]))


def _score(buckets: Column, weights: Sequence[float]) -> Column:
    """Log-odds of a block under ``weights``, whose last is the constant."""
    known = F.expr("array(" + ",".join(f"{w!r}D" for w in weights[:-1]) + ")")
    total = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(known, b))
    return total / F.sqrt(F.greatest(F.lit(1), F.size(buckets))) + F.lit(float(weights[-1]))


def trained(labelled: DataFrame, *, most_rows: int = 20_000, steps: int = STEPS, rate: float = 1.0, ridge: float = 1e-4) -> list[float]:
    """``BUCKETS`` + 1 weights of the logistic regression for (url, blocked).

    Full-batch steps with per-weight scaling: each is one aggregation over the labelled rows, of which
    only ``BUCKETS`` sums reach the driver. At most ``most_rows`` labelled rows, those of the lowest hash, are used.
    Rows without a label or with an empty URL are left out; without rows all weights are 0.
    """
    host, path = split_url(F.col("url"))
    rows = labelled.where("blocked IS NOT NULL").select("blocked", host.alias("host"), path.alias("path")).where("host <> ''")
    rows = rows.orderBy(F.xxhash64("host", "path", "blocked")).limit(most_rows)
    rows = written_once(rows.select("blocked", _buckets(F.col("host"), F.col("path")).alias("buckets")), "labelled")
    count = rows.count()
    weights, scale = [0.0] * (BUCKETS + 1), [1e-8] * (BUCKETS + 1)
    for _ in range(steps if count else 0):
        error = F.col("blocked") - 1 / (1 + F.exp(-_score(F.col("buckets"), weights)))
        part = rows.select("buckets", error.alias("error")).select(
            F.explode(F.concat("buckets", F.array(F.lit(BUCKETS)))).alias("bucket"),
            (F.col("error") / F.sqrt(F.greatest(F.lit(1), F.size("buckets")))).alias("part"), "error")
        sums = part.groupBy("bucket").agg(F.sum("part").alias("part"), F.sum("error").alias("error")).collect()
        for r in sums:
            slope = (r.error if r.bucket == BUCKETS else r.part) / count - ridge * weights[r.bucket]
            scale[r.bucket] += slope * slope
            weights[r.bucket] += rate * slope / math.sqrt(scale[r.bucket])
    return weights


def judged_urls(
    pages: DataFrame, labelled: DataFrame, *, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5,
) -> DataFrame:
    """Verdicts on URLs: the longest fitting rule's, else that of the regression trained on ``labelled``.

    One row per row of ``pages``: id, host, path, rule (host and path of the rule, else null), score (probability
    of a block by the regression), verdict (allow or block). Null URLs and such without ``://`` have an
    empty host and path, fit no rule and are judged by the regression's constant. Repeated rows get the same verdict. Other columns are not looked at.
    """
    weights = trained(labelled)
    host, path = split_url(F.col(url_col))
    cut = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    score = F.when(F.col("host") == "", 1 / (1 + F.exp(F.lit(-weights[-1])))).otherwise(
        1 / (1 + F.exp(-_score(_buckets(F.col("host"), F.col("path")), weights))))
    return cut.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), score.alias("score"), verdict.alias("by_rule")
    ).withColumn("verdict", F.coalesce("by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow"))).drop("by_rule")
