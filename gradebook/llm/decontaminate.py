"""Benchmark decontamination: a prefix-filtered set join of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradebook.llm.bitmaps import bitmap, passes
from gradebook.llm.tokens import ALNUM, pieces, shingles, words_of
from gradebook.sources.checkpoints import written_once


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 5,
) -> DataFrame:
    """How much of each document is covered by windows of benchmark items.

    Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. A
    window is ``window`` consecutive words of an item; an item of fewer words is
    one window. A document word inside any occurrence of a window is hit.

    Method: windows and documents are sets of shingles (``shingle`` words, all of
    a shorter window). Shingles are ordered by how often they occur in the corpus.
    As a window must be contained whole, its rarest shingle is the only prefix
    token that has to be joined; a window one of whose shingles occurs nowhere is
    dropped. A pair that meets gives the place of the window in the document;
    it must lie inside a run of known shingles (length and position), and the
    words themselves are compared. A fixed-size bitmap of the benchmark's shingles
    keeps the rest of the corpus out of the shuffle; it may pass too much, never too little.

    One row per row of ``docs``: id, n_words, n_hit, n_items, items (array of item
    ids as strings, sorted), contaminated, and ``text_hash`` (xxhash64 of the text).
    A null text has no words. Rows are judged on their own text, also if they
    share an id or lack one. Items without words or id are ignored; items that
    share an id count as one. Without items nothing is hit. Other columns are not looked at.
    """
    windows = written_once(_windows(benchmark, item_col, item_text_col, window, shingle), "windows")
    lengths = {r["k"]: r["least"] for r in windows.groupBy("k").agg(F.min(F.size("hashes")).alias("least")).collect()}
    scan = written_once(_scan(docs, id_col, text_col, lengths, bitmap(windows.select(F.explode("hashes").alias("hash")))), "scan")
    base = scan.where("k = 0").select("id", "text_hash", "n_words")
    hits = _verified(scan.where("k > 0"), _prefixes(scan, windows), max(0, window - shingle))
    hits = written_once(hits, "hits")

    earlier = Window.partitionBy("id", "text_hash").orderBy("start", "w").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        hits.select("id", "text_hash", "start", "w").distinct()
        .withColumn("reached", F.coalesce(F.max(F.col("start") + F.col("w")).over(earlier), F.lit(0)))
        .groupBy("id", "text_hash")
        .agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("w") - F.greatest("start", "reached"))).alias("n_hit")))
    items = (
        hits.select("id", "text_hash", "win").distinct()
        .join(windows.select("win", "item"), "win")
        .select("id", "text_hash", "item").distinct()
        .groupBy("id", "text_hash").agg(F.sort_array(F.collect_list("item")).alias("items")))
    found = (
        covered.alias("c").join(items.alias("i"), F.expr("c.id <=> i.id AND c.text_hash = i.text_hash"))
        .select("c.id", "c.text_hash", "n_hit", "items"))
    return (
        base.alias("b").join(found.alias("f"), F.expr("b.id <=> f.id AND b.text_hash = f.text_hash"), "left")
        .select(
            F.col("b.id").alias(id_col), F.col("b.text_hash").alias("text_hash"), "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.col("n_hit").isNotNull().alias("contaminated")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns."""
    hit = (
        contamination(docs.select(id_col, text_col), benchmark, id_col=id_col, text_col=text_col)
        .where("contaminated").select(id_col, "text_hash").distinct())
    return docs.join(hit, docs[id_col].eqNullSafe(hit[id_col]) & (F.xxhash64(docs[text_col]) == hit["text_hash"]), "left_anti")


def _windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """(item, win: words with spaces between them, w: number of words, k: shingle length, hashes), distinct."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in pieces(batch.column("text")):
                words = words_of(data, bounds, ALNUM)
                known = {k: shingles(words, k)[0] for k in range(1, shingle + 1)}
                out: dict[str, list] = {c: [] for c in ("item", "win", "w", "k", "hashes")}
                for i in range(len(bounds) - 1):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    w = min(window, b - a)
                    k = min(shingle, w)
                    for s in range(a, b - w + 1) if w else ():
                        out["item"].append(batch.column("item")[row + i].as_py())
                        out["win"].append(words.text(s, s + w))
                        out["w"].append(w)
                        out["k"].append(k)
                        out["hashes"].append(known[k][s:s + w - k + 1].view(np.int64))
                yield pa.record_batch(
                    [pa.array(out["item"], pa.string()), pa.array(out["win"], pa.string()), pa.array(out["w"], pa.int32()),
                     pa.array(out["k"], pa.int32()), pa.array(out["hashes"], pa.list_(pa.int64()))],
                    names=list(out))

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return items.where("item IS NOT NULL").mapInArrow(
        cut, "item string, win string, w int, k int, hashes array<bigint>").distinct()


def _scan(docs: DataFrame, id_col: str, text_col: str, lengths: dict[int, int], bits: np.ndarray) -> DataFrame:
    """A row with k = 0 per document, and one per run of k-word shingles that pass the filter."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    kind = source.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in pieces(batch.column("text")):
                words = words_of(data, bounds, ALNUM)
                n = len(bounds) - 1
                doc, at, length, text, hashes = [np.arange(n)], [np.full(n, -1)], [np.zeros(n, np.int64)], [""] * n, [None] * n
                for k, least in lengths.items():
                    h, whole = shingles(words, k)
                    runs, ends = _runs(whole & passes(bits, h), words.first, least)
                    of = np.searchsorted(words.first, runs, "right") - 1
                    doc.append(of)
                    at.append(runs - words.first[of])
                    length.append(np.full(len(runs), k))
                    text += [words.text(a, b + k - 1) for a, b in zip(runs, ends)]
                    hashes += [h[a:b].view(np.int64) for a, b in zip(runs, ends)]
                doc = np.concatenate(doc)
                take = pa.array(doc + row)
                yield pa.record_batch(
                    [batch.column("id").take(take), batch.column("text_hash").take(take),
                     pa.array(np.diff(words.first)[doc], pa.int64()), pa.array(np.concatenate(at), pa.int32()),
                     pa.array(np.concatenate(length), pa.int32()), pa.array(text, pa.string()),
                     pa.array(hashes, pa.list_(pa.int64()))],
                    names=["id", "text_hash", "n_words", "start", "k", "words", "hashes"])

    return source.mapInArrow(
        scan, f"id {kind}, text_hash bigint, n_words bigint, start int, k int, words string, hashes array<bigint>")


def _runs(good: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of runs of true values of at least ``least``, cut where a text begins."""
    cut = np.zeros(len(good) + 1, bool)
    cut[first[first <= len(good)]] = True
    before = np.concatenate(([False], good))[:len(good)]
    after = np.concatenate((good, [False]))[1:]
    a = np.flatnonzero(good & (~before | cut[:-1]))
    b = np.flatnonzero(good & (~after | cut[1:])) + 1
    long = b - a >= least
    return a[long], b[long]


def _prefixes(scan: DataFrame, windows: DataFrame) -> DataFrame:
    """(hash, at, win, w, k) of the rarest shingle of every window all of whose shingles occur."""
    counts = (
        scan.where("k > 0").select("k", F.explode("hashes").alias("hash"))
        .groupBy("k", "hash").agg(F.count("*").alias("n")))
    tokens = windows.select("win", "w", "k", "hashes").distinct().select(
        "win", "w", "k", F.size("hashes").alias("size"), F.posexplode("hashes").alias("at", "hash"))
    return (
        tokens.join(counts, ["k", "hash"]).groupBy("win", "w", "k", "size")
        .agg(F.count("*").alias("known"), F.min(F.struct("n", "hash", "at")).alias("rarest"))
        .where("known = size").select("win", "w", "k", "size", "rarest.hash", "rarest.at"))


def _verified(runs: DataFrame, prefixes: DataFrame, reach: int) -> DataFrame:
    """(id, text_hash, start, w, win) of windows that occur word by word.

    ``reach``: words that a window can have on either side of one of its shingles.
    Only these travel with a shingle.
    """
    begin = F.greatest(F.lit(0), F.col("i") - F.lit(reach))
    place = F.col("i") - F.col("at")
    near = (
        runs.select(
            "id", "text_hash", "k", "start", F.size("hashes").alias("run"), F.split("words", " ").alias("words"),
            F.posexplode("hashes").alias("i", "hash"))
        .select("id", "text_hash", "k", "start", "run", "i", "hash", begin.alias("begin"),
                F.slice("words", begin + 1, F.col("k") + 2 * reach).alias("near")))
    return (
        near.join(prefixes, ["k", "hash"])
        .where((place >= 0) & (place + F.col("size") <= F.col("run")))
        .where(F.array_join(F.slice("near", F.greatest(F.lit(1), place - F.col("begin") + 1), F.col("w")), " ") == F.col("win"))
        .select("id", "text_hash", (F.col("start") + place).alias("start"), "w", "win").distinct())
