"""Quality rules: repetition counts, and distribution divergence from language references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.llm.names import unused
from gradebook.sources.checkpoints import written_once

SPACE = r"[\x20\x09-\x0D]+"

# Frequent words of four languages, whose shares are compared.
COMMON_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "that",
    "der", "die", "und", "den", "von", "das", "zu", "mit",
    "de", "la", "le", "et", "les", "des", "en", "un",
    "que", "el", "y", "los", "del", "se", "las", "por",
]

#: Distances (0 to 1) from which a document is rejected, and the words it must have for a verdict. A text without any
#: common word is 0.276 to 0.306 from its language in the given tables, so the limit of words lies below that.
MOST_CLASS_DISTANCE = 0.30
MOST_WORD_DISTANCE = 0.27
LEAST_WORDS = 50

#: Classes whose shares are compared; foreign: bytes beyond the first of characters outside ASCII.
CLASSES = ("letters", "spaces", "symbols", "capitals", "digits", "punctuation", "foreign")


def quality(
    docs: DataFrame, *, keep: Sequence[str], text_col: str = "text", lang_col: str = "lang", into: str = "_quality",
    most_class_distance: float = MOST_CLASS_DISTANCE, most_word_distance: float = MOST_WORD_DISTANCE,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """The columns ``keep`` of every row and a struct ``into``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, class_distance, word_distance, kept.

    Words are runs of characters other than space, tab and line ends. A document fails the base rules with
    fewer than 20 words, or if more than 30 in 100 of its words lie in 8-word windows found
    twice or more in it. The others are rejected if their shares of character classes, or
    of frequent words, are farther from those of their language than the limits, by
    Jensen-Shannon distance to base 2. The references are the pooled counts of all documents of the
    language. Documents of fewer than ``least_words`` words have too unsteady shares and are kept.

    The counts are written once with the kept columns, then summed to the references and
    compared with them. Rows are judged on their own; repeated rows get the same verdict. A null text
    has no words; a null language is a language of its own. A kept column that is named ``into`` is replaced.
    """
    kept = [c for c in keep if c != into]
    counted = written_once(_counts(docs, kept, text_col, lang_col), "counts")
    classes, words = len(CLASSES), len(COMMON_WORDS) + 1
    names = [*[f"c{i}" for i in range(classes)], *[f"w{i}" for i in range(words)]]
    totals = (
        counted.select("_q.lang", *_spread("_q.classes", "c", classes), *_spread("_q.words", "w", words))
        .groupBy("lang").agg(*[F.sum(n).alias(n) for n in names]))
    # Written first, so that its size is known when the join is planned.
    reference = written_once(totals.select(
        F.col("lang").alias("_lang"), F.array(*names[:classes]).alias("_ref_classes"), F.array(*names[classes:]).alias("_ref_words")),
        "references")
    judged = counted.join(reference, F.col("_q.lang").eqNullSafe(F.col("_lang")), "left").withColumns({
        "_far_classes": jensen_shannon(F.col("_q.classes"), F.col("_ref_classes")),
        "_far_words": jensen_shannon(F.col("_q.words"), F.col("_ref_words")),
    })
    n, repeats = F.col("_q.n_words"), F.col("_q.n_repeat_words")
    failed = (n < 20) | (100 * repeats > 30 * n)
    far = (n >= least_words) & ((F.col("_far_classes") > most_class_distance) | (F.col("_far_words") > most_word_distance))
    result = F.struct(
        *[F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), F.col("_far_classes").alias("class_distance"), F.col("_far_words").alias("word_distance"),
        (~failed & ~far).alias("kept"))
    return judged.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], result.alias(into))


def passing_quality(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass the rules, with all their columns."""
    columns = docs.columns
    into = unused(docs, "_quality")
    return quality(docs, keep=columns, into=into, **options).where(F.col(f"{into}.kept")).select(*columns)


def jensen_shannon(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance to base 2 of two arrays of counts; 0 if one of them is empty of counts."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: x / total(a))
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(share(left), share(right), lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))
    return F.when((total(left) > 0) & (total(right) > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2))).otherwise(0.0)


def _spread(column: str, prefix: str, size: int) -> list[Column]:
    return [F.col(column)[i].alias(f"{prefix}{i}") for i in range(size)]


def _counts(docs: DataFrame, keep: list[str], text_col: str, lang_col: str) -> DataFrame:
    """The columns ``keep`` as k0, k1 ... and a struct ``_q`` of the counts of each text.

    Each step is a column of its own, so that nothing is computed again for every element of an array.
    """
    without = lambda column, pattern: F.regexp_replace(column, pattern, "")
    long = lambda column: column.cast("bigint")
    steps = docs.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(lang_col).alias("lang"),
        F.coalesce(text_col, F.lit("")).alias("text"))
    steps = steps.withColumns({
        "words": F.array_remove(F.split("text", SPACE), ""),
        "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        "marks": without("text", "[^!-`{-~]+"),  # capitals, digits, punctuation and symbols
    }).withColumns({
        "n": long(F.size("words")), "chars": long(F.length(F.array_join("words", ""))),
        "symbols": long(F.length(without("marks", "[^#*$%&|<>]+"))),
        "capitals": long(F.length(without("marks", "[^A-Z]+"))),
        "digits": long(F.length(without("marks", "[^0-9]+"))),
        "marks": long(F.length("marks")),
        "foreign": long(F.octet_length("text") - F.length("text")),
        "dup_lines": long(F.size("lines") - F.size(F.array_distinct("lines"))),
        "hits": F.filter("words", lambda w: w.isin(COMMON_WORDS)),
        "grams": F.transform("words", lambda w: F.xxhash64(w)),
    }).withColumn("hits", F.transform("hits", lambda w: F.array_position(F.array(*map(F.lit, COMMON_WORDS)), w).cast("int")))
    for apart in (1, 2, 4):  # hashes of 2, 4, then 8 words
        rest = F.greatest(F.lit(0), F.size("grams") - apart)
        steps = steps.withColumn("grams", F.zip_with(
            F.slice("grams", F.lit(1), rest), F.slice("grams", F.lit(apart + 1), rest), lambda a, b: F.xxhash64(a, b)))
    marks = F.col("marks") - F.col("symbols") - F.col("capitals") - F.col("digits")
    counts = F.struct(
        "lang", F.col("n").alias("n_words"), F.col("chars").alias("word_chars"), F.col("symbols").alias("n_symbols"),
        F.col("dup_lines").alias("n_dup_lines"), F.col("repeats").alias("n_repeat_words"),
        F.array(
            F.greatest(F.lit(0), F.col("chars") - F.col("marks") - F.col("foreign")), long(F.length("text")) - F.col("chars"),
            F.col("symbols"), F.col("capitals"), F.col("digits"), marks, F.col("foreign")).alias("classes"),
        F.array(
            *[long(F.size("hits") - F.size(F.array_remove("hits", i + 1))) for i in range(len(COMMON_WORDS))],
            F.col("n") - F.size("hits")).alias("words"))
    return _with_repeats(steps).select(*[f"k{i}" for i in range(len(keep))], counts.alias("_q"))


def _with_repeats(df: DataFrame) -> DataFrame:
    """Add ``repeats``: words covered by 8-word windows whose hash is found twice or more.

    The hashes are sorted with their places only in texts that have equal ones.
    """
    place = lambda j: F.col("order")[j]["g"]
    return (
        df.withColumn("order", F.when(
            F.size(F.array_distinct("grams")) < F.size("grams"),
            F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
            .otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
        .withColumn("at", F.filter("order", lambda x, j: (
            F.when(j > 0, place(j - 1) == x["g"]).otherwise(False)
            | F.when(j < F.size("order") - 1, place(j + 1) == x["g"]).otherwise(False))))
        .withColumn("at", F.sort_array(F.transform("at", lambda x: x["i"])))
        .withColumn("repeats", F.aggregate(
            "at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
            lambda s, i: F.struct((s["n"] + i + 8 - F.greatest(i, s["to"])).alias("n"), (i + 8).alias("to")),
            lambda s: s["n"].cast("bigint"))))
