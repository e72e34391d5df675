"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.sources.checkpoints import written_once

#: A path's odds are those of at least this chance of either kind.
LEAST_CHANCE = 1e-6
#: Bins of each feature; the classifier's table has at most six times as many rows.
BINS = 16


def site_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    label_col: str = "quality", threshold: float = 0.5,
) -> DataFrame:
    """Score documents by their own features and by the site they come from.

    Evidence is a naive Bayes log-odds over six binned features (words, distinct words, mean word length, shares of symbols,
    of capitals and of repeated lines), fitted to all labelled documents. Labels where there are, and
    the classifier's probabilities elsewhere, are summed per (host, path) and host. Each host's mean is a beta posterior around
    the global mean, each path's around its host's; the strength of either prior is
    estimated from the spread of the level below (moments), so sparse sites stay near the level above. A document's score joins its evidence with
    the odds of its path, both posteriors taken over the *other* documents, so nothing counts twice; the only document of a host gets the global mean.

    One row per row of ``docs``: id, evidence, host_posterior, path_posterior, score, kept (score >= threshold). Null hosts and paths are
    groups of their own. A document without words gets the evidence of the lowest bins. Repeated rows count each. Of several labels of an id the mean
    counts, rounded; ids without a row and null labels are ignored. Without labels the evidence is 0. Other columns are not looked at.
    """
    rows = written_once(_features(docs, id_col, text_col, host_col, path_col), "features")
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
        .agg(F.round(F.avg(label_col)).cast("int").alias("label")))
    labelled = rows.join(known, "id", "left")
    # At most 6 * BINS rows of counts, whatever the number of documents.
    counts = (
        labelled.where("label IS NOT NULL").select("label", F.posexplode("bins").alias("feature", "bin"))
        .groupBy("feature", "bin").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect())
    good = sum(r.good for r in counts if r.feature == 0)
    bad = sum(r.bad for r in counts if r.feature == 0)
    evidence = _evidence(counts, good, bad)
    prior = (good + 1.0) / (good + bad + 2.0)
    chance = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.lit(prior / (1 - prior))))))
    scored = written_once(
        labelled.select("id", "host", "path", "label", evidence.alias("evidence"))
        .withColumn("share", F.coalesce(F.col("label").cast("double"), chance)), "evidence")

    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("share").alias("s"))
    hosts = written_once(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")), "hosts")
    each = F.col("host_s") / F.col("host_n")
    top = hosts.agg(F.sum("host_s").alias("s"), F.sum("host_n").alias("n"), F.avg(each).alias("m"), F.var_pop(each).alias("v")).first()
    mean = F.lit(top.s / top.n if top.n else prior)
    over = _strength(top.m, top.v)
    host_mean = _shrunk(F.col("host_s"), F.col("host_n"), mean, over)
    sites = written_once(paths.alias("p").join(hosts.alias("h"), F.expr("p.host <=> h.host")).select("p.host", "path", "n", "s", "host_n", "host_s"), "sites")
    within = sites.select(host_mean.alias("m"), F.pow(F.col("s") / F.col("n") - host_mean, 2).alias("d")).agg(F.avg("m").alias("m"), F.avg("d").alias("v")).first()
    under = _strength(within.m, within.v)
    # A document's own part is taken out of its host's and path's sums, as its evidence counts on its own.
    others = _shrunk(F.col("host_s") - F.col("share"), F.col("host_n") - 1, mean, over)
    of_path = _shrunk(F.col("s") - F.col("share"), F.col("n") - 1, F.col("host_posterior"), under)
    sure = F.least(F.lit(1 - LEAST_CHANCE), F.greatest(F.lit(LEAST_CHANCE), "path_posterior"))
    odds = F.log(sure / (1 - sure))
    return (
        scored.alias("d").join(sites.alias("t"), F.expr("d.host <=> t.host AND d.path <=> t.path"))
        .withColumn("host_posterior", others).withColumn("path_posterior", of_path)
        .select(F.col("id").alias(id_col), "evidence", "host_posterior", "path_posterior", (1 / (1 + F.exp(-(F.col("evidence") + odds)))).alias("score"))
        .withColumn("kept", F.col("score") >= threshold))


def _strength(mean: float | None, variance: float | None) -> float:
    """How many documents the prior of a level weighs, by moments: none where the level below spreads as far as shares can, all where it does not spread."""
    if mean is None or not variance:
        return math.inf
    return max(0.0, mean * (1 - mean) / variance - 1)


def _shrunk(total: Column, n: Column, prior: Column, strength: float) -> Column:
    """The mean of ``n`` shares, drawn towards a prior mean that weighs ``strength`` of them; the prior where there is none."""
    weight = n / (n + F.lit(strength))
    return F.when(n <= 0, prior).otherwise(weight * total / n + (1 - weight) * prior)


def _features(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    text = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.coalesce(text_col, F.lit("")).alias("text"))
    parts = text.withColumns({
        "words": F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""), "lines": F.split("text", "\n"),
        "marks": F.regexp_replace("text", "[^!-`{-~]+", ""),
    }).withColumns({
        "n": F.size("words"), "distinct": F.size(F.array_distinct("words")), "chars": F.greatest(F.lit(1), F.length("text")),
        "symbols": F.length(F.regexp_replace("marks", r"[^#*$%&|<>{}\[\]=~^_\\/+]+", "")),
        "capitals": F.length(F.regexp_replace("marks", "[^A-Z]+", "")),
        "lines": F.size("lines"), "once": F.size(F.array_distinct("lines")),
    })
    binned = lambda c: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(c).cast("int")))
    n = F.greatest(F.lit(1), F.col("n"))
    log = lambda c: F.log2(1 + c)
    return parts.select("id", "host", "path", F.array(
        binned(F.log2(1 + F.col("n"))), binned(BINS * F.col("distinct") / n - 1e-9), binned(F.col("chars") / n - 2),
        binned(log(1000 * F.col("symbols") / F.col("chars")) * 1.5), binned(log(1000 * F.col("capitals") / F.col("chars")) * 1.5),
        binned(BINS * (1 - F.col("once") / F.col("lines")))).alias("bins"))


def _evidence(counts: list, good: int, bad: int) -> Column:
    """Sum of the log-odds of the bins. Bins that no label has seen say nothing."""
    if not good or not bad:
        return F.lit(0.0)
    total = F.lit(0.0)
    for feature in range(6):
        odds = F.lit(0.0)
        for r in counts:
            if r.feature == feature:
                ratio = ((r.good + 1.0) / (good + BINS)) / ((r.bad + 1.0) / (bad + BINS))
                odds = F.when(F.col("bins")[feature] == r.bin, F.log(F.lit(ratio))).otherwise(odds)
        total = total + odds
    return total
