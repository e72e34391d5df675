"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.operators.positions import number_within
from gradebook.sources.checkpoints import written_once

#: Sizes from 1024 on are told apart by their ten leading bits, so a source has at most some 28,000 size classes.
_EXACT = 1024


def targets(sources: DataFrame, *, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add ``place`` (1 ...) and ``target`` to rows (source, source_size).

    Sources in code point order, null last, weigh ``weights``, repeating. Together they get
    ``share`` of all sizes by weight; a target stops at ``most`` times its source's size and
    the excess is shared again by weight until none is above. If all stop, the rest is left out.
    """
    in_order = [F.col("source").isNull(), F.col("source")]
    placed = number_within(sources.withColumn("_all", F.lit(0)), "_all", in_order, "place").drop("_all")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = written_once(
        placed.withColumn("weight", cycle[F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")])
        .withColumn("cap", F.lit(float(most)) * F.col("source_size")), "sources")
    level, stopped = None, None
    while True:
        stops = F.lit(False) if level is None else F.col("weight") * level >= F.col("cap")
        row = placed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(stops, F.col("cap"))), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.coalesce(F.sum(stops.cast("int")), F.lit(0)).alias("stopped")).first()
        if row.weight == 0 or row.stopped == stopped:
            break
        level, stopped = max(0.0, (share * row.all - row.capped) / row.weight), row.stopped
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.col("weight") * level)
    return placed.select("source", "source_size", "place", target.alias("target"))


def mixed_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2,
) -> DataFrame:
    """How often each document is taken so that its source reaches its target.

    A document's size is its number of words (runs of characters other than space, tab and line
    ends; a null text has none). Method: rates w minimise the relative entropy to one copy each
    subject to sum(w * size) = target within every source and w <= ``most``. The solution is
    w = min(most, exp(lambda * size / mean size)); its convex dual has one unknown per source and is solved by
    Newton steps, kept inside a shrinking bracket, each one aggregation over (source, size) counts. Rates become whole copies
    from the largest sizes down: a size takes the whole number of copies nearest to what it should plus what the
    larger ones left over, so a source ends within about its smallest document of the target. Which
    documents of one size are taken is decided by a hash of id and text.

    One row per row of ``docs``: id, row_hash (xxhash64 of id and text), source, size, source_size, target,
    rate, copies (0 ... most), taken (copies * size). Null is a source of its own. Repeated rows count each;
    they may differ in copies. Empty documents have size 0 and are taken once. Other columns are not looked at.
    """
    sized = written_once(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_hash"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size")), "sizes")
    sources = written_once(targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, most=most), "targets")
    shift = F.floor(F.log2(F.greatest(F.col("size"), F.lit(_EXACT)))).cast("int") - 9
    group = F.when(F.col("size") < _EXACT, F.col("size")).otherwise(
        shift * (_EXACT // 2) + F.floor(F.col("size") / F.pow(F.lit(2.0), shift)))
    sized = sized.alias("d").join(sources.alias("s"), F.expr("d.source <=> s.source")).select(
        "id", "row_hash", "d.source", "size", "source_size", "target", "place", (F.col("place") * 32768 + group).alias("class"))
    counts = written_once(
        sized.groupBy("place", "class").agg(
            F.count("*").alias("n"), (F.sum("size") / F.count("*")).alias("x"), F.first("source_size").alias("source_size"),
            F.first("target").alias("target")), "counts")
    rounded = written_once(_rounded(counts, _solved(counts, most), most), "copies")
    turned = number_within(
        sized.select("id", "row_hash", "source", "size", "source_size", "target", "class"), "class",
        [F.col("row_hash"), F.col("id")], "turn")
    upto = lambda r: F.floor(F.col("k") * r / F.col("n"))
    return (
        turned.join(rounded, "class")
        .withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(upto(F.col("turn")) - upto(F.col("turn") - 1)).cast("bigint"))
        .select(F.col("id").alias(id_col), "row_hash", F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies",
                (F.col("copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns and ``copy`` (1 ...).

    Rows that repeat id, text and source are taken as often as the one of them that is taken most. A column named ``copy`` is replaced.
    """
    copies = (
        mixed_copies(docs.select(id_col, text_col, source_col), id_col=id_col, text_col=text_col, source_col=source_col, **options)
        .where("copies > 0").groupBy(id_col, "row_hash", source_col).agg(F.max("copies").alias("copies")))
    same = (
        (F.xxhash64(docs[id_col], docs[text_col]) == copies["row_hash"]) & docs[id_col].eqNullSafe(copies[id_col])
        & docs[source_col].eqNullSafe(copies[source_col]))
    kept = [c for c in docs.columns if c != "copy"]
    return docs.join(copies, same).select(*[docs[c] for c in kept], F.explode(F.sequence(F.lit(1), copies["copies"].cast("int"))).alias("copy"))


def _rate(step: Column, x: Column, mean: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(step * x / mean, F.lit(50.0))))


def _solved(counts: DataFrame, most: int) -> DataFrame:
    """(place, step, mean): the dual's solution for each source with a size and a target."""
    log_most = F.log(F.lit(float(most)))
    filled = counts.where("x > 0")
    start = filled.groupBy("place").agg(
        F.first("source_size").alias("size"), F.first("target").alias("target"),
        (F.first("source_size") / F.sum("n")).alias("mean"), F.min("x").alias("least"))
    ratio = F.log(F.col("target") / F.col("size"))
    state = start.where("target > 0").select(
        "place", "size", "target", "mean",
        F.least(F.lit(0.0), ratio * F.col("mean") / F.col("least")).alias("low"),
        (log_most * F.col("mean") / F.col("least")).alias("high"), F.least(log_most, ratio).alias("step"))
    # Written tables: the few rows are computed once and broadcast, so that the classes are not shuffled in every step.
    state = written_once(state, "state")
    for _ in range(100):
        u = F.col("step") * F.col("x") / F.col("mean")
        rate = _rate(F.col("step"), F.col("x"), F.col("mean"), most)
        sums = filled.select("place", "n", "x").join(state, "place").groupBy("place").agg(
            F.sum(F.col("n") * F.col("x") * rate).alias("f"),
            F.sum(F.when(u < log_most, F.col("n") * F.col("x") * F.col("x") / F.col("mean") * rate).otherwise(0.0)).alias("slope"))
        gap = F.col("f") - F.col("target")
        low, high = F.when(gap < 0, F.col("step")).otherwise(F.col("low")), F.when(gap > 0, F.col("step")).otherwise(F.col("high"))
        newton = F.col("step") - gap / F.col("slope")
        state = written_once(
            state.join(sums, "place")
            .withColumns({"gap": F.abs(gap) / F.col("target"), "newton": F.when(F.col("slope") > 0, newton), "below": low, "above": high})
            .select("place", "size", "target", "mean", F.col("below").alias("low"), F.col("above").alias("high"), F.when(
                F.col("gap") < 1e-9, F.col("step")).when(
                (F.col("newton") > F.col("below")) & (F.col("newton") < F.col("above")), F.col("newton")).otherwise(
                (F.col("below") + F.col("above")) / 2).alias("step"), "gap"), "state")
        if not state.where("gap >= 1e-7").limit(1).count():
            break
        state = state.drop("gap")
    return state.select("place", F.round("step", 9).alias("step"), "mean")


def _rounded(counts: DataFrame, solved: DataFrame, most: int) -> DataFrame:
    """(class, n, rate, k): how many copies the documents of each class get together."""
    rated = counts.join(solved, "place", "left").withColumn(
        "rate", F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= most * F.col("source_size"), float(most)).otherwise(
            F.coalesce(_rate(F.col("step"), F.col("x"), F.col("mean"), most), F.lit(0.0))))
    entry = F.struct(F.col("x").alias("x"), F.col("class").alias("class"), F.col("n").alias("n"), F.col("rate").alias("rate"))
    # The size classes of a source, largest first; their number is bounded, whatever the number of documents.
    folded = rated.where("x > 0").groupBy("place").agg(
        F.first("target").alias("target"), F.sort_array(F.collect_list(entry), asc=False).alias("classes"))
    total = F.aggregate("classes", F.lit(0.0), lambda s, c: s + c["n"] * c["x"] * c["rate"])
    none = F.array().cast("array<struct<class:bigint,n:bigint,rate:double,k:bigint>>")
    want = lambda s, c: s["rest"] + c["n"] * c["x"] * c["rate"]
    k = lambda s, c: F.greatest(F.lit(0), F.least(most * c["n"], F.round(want(s, c) / c["x"]).cast("bigint")))
    # What the rates themselves miss of the target is left over from the start.
    walk = F.aggregate(
        "classes", F.struct((F.col("target") - total).alias("rest"), none.alias("out")),
        lambda s, c: F.struct(
            (want(s, c) - k(s, c) * c["x"]).alias("rest"),
            F.concat(s["out"], F.array(F.struct(
                c["class"].alias("class"), c["n"].alias("n"), c["rate"].alias("rate"), k(s, c).alias("k")))).alias("out")),
        lambda s: s["out"])
    empty = counts.where("x = 0").select("class", "n", F.lit(1.0).alias("rate"), F.col("n").alias("k"))
    return folded.select(F.inline(walk)).unionByName(empty)
