"""Removal of repeated substrings by the names of sampled windows, in two levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.llm.bitmaps import bitmap, passes
from gradebook.llm.tokens import BASE, INVERSE, mixed, pieces, powers
from gradebook.sources.checkpoints import written_once

_RANDOM = np.random.default_rng(40)
_FIRST, _SECOND = (_RANDOM.integers(1, 2**63, 256, dtype=np.uint64) for _ in range(2))
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE2 = np.uint64(pow(int(_BASE2), -1, 2**64))
_LAST = 2**63 - 1
_SHORT = 511
_TOGETHER = 1 << 23


def repeated_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Mark every byte covered by a ``length``-byte string that also starts earlier.

    Earlier: in a document of smaller id, or before it in the same document. Texts are UTF-8
    bytes and matches never cross documents; strings are judged on the input.

    Method, a replacement of external induced sorting (see the README): windows are named by
    hashes instead of being ranked, at sampled places only. Sampled are the places whose hashed prefix of a fifth of ``length`` bytes is the least in some window of
    ``length`` bytes, so equal windows hold the same sample at the same place, and
    there are about 40 bytes from one sample to the next. A sample's tuple holds the name (hash) of its
    prefix, the name of all text its windows cover, and its place. A shuffle
    brings equal names together (first level). Windows of samples whose whole text was seen
    earlier are repeated; those of samples with a name of their own are not. Only where
    samples agree in the prefix and on one side of it, but not in all of their text, the windows
    of that side are named themselves (second level). Names of whole texts and windows have 128 bits.
    Before each shuffle only the first tuple of a name in a few MB of text is kept, so a name has at most one row for each of these.

    One row per row of ``docs``: id, n_bytes, n_removed, spans (array of start, end of
    the maximal removed runs), kept (the remaining bytes). Ids are cast to BIGINT. A null text
    is empty. Rows without id come after all others; rows that share an id are ordered by a hash of
    their texts; rows that repeat id and text count as one document and get the same
    result. ``length`` may be 20 to 150. Texts shorter than ``length`` are left alone. Other columns are not looked at.
    """
    if not 20 <= length <= 150:
        raise ValueError("length must be from 20 to 150")
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc")
    unclear = docs.select(doc).groupBy("doc").count().where(f"count > 1 OR doc = {_LAST}").limit(1).count() > 0
    tie = F.xxhash64(text_col) if unclear else F.lit(0).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), doc, tie.alias("tie"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = rows.select("doc", "tie", "text")
    if unclear:
        texts = texts.dropDuplicates(["doc", "tie"])

    first = written_once(_first_level(texts, length), "samples")
    second = written_once(_second_level(texts, first.where("unsure"), length), "windows")
    spans = (
        first.where("NOT unsure").select("doc", "tie", "start", "end").unionByName(second)
        .groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    spans = written_once(spans, "spans")
    # Documents without a span need not be moved to it.
    bits = bitmap(spans.select(F.xxhash64("doc", "tie").alias("hash")))
    hashed = rows.withColumn("hash", F.xxhash64("doc", "tie"))
    kind = docs.schema[id_col].dataType.simpleString()
    touched = hashed.mapInArrow(_sifted(bits, True), f"id {kind}, doc bigint, tie bigint, text string")
    return _cut(touched.join(spans, ["doc", "tie"], "left").select("id", "text", "spans"), id_col).unionByName(
        _cut(hashed.select("id", "text", "hash"), id_col, bits))


def _sums(data: np.ndarray, table: np.ndarray, base: np.uint64) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(base, len(data)), out=sums[1:])
    return sums


def _names(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * inverse[start])


def _width(length: int) -> int:
    """Places among which a window's sample is chosen; the rest of the window is the sample's prefix."""
    return max(2, length * 4 // 5)


def _samples(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(prefix name, text name, text index, sample, first window, last window, short names of both sides) in order.

    A window that begins within half the width before its sample holds the half width
    after the prefix, any other the half width before the sample: windows cannot be equal unless the short name
    of that side is.
    """
    width = _width(length)
    k, half = length - width + 1, width // 2
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none, none, none
    sums, inverse = _sums(data, _FIRST, BASE), powers(INVERSE, n + 1)
    grams = mixed((sums[k:] - sums[:-k]) * inverse[:n - k + 1])
    least, step = grams, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[:step - width], least[width - step:])
    count = n - length + 1
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    valid = text[:count] == text[length - 1:]
    change = np.ones(count, bool)
    change[1:] = (least[1:count] != least[:count - 1]) | (text[1:count] != text[:count - 1])
    begin = np.flatnonzero(change)
    stop = np.concatenate((begin[1:], [count])) - 1
    # Windows that reach into the next text are no windows: cut them off the runs.
    stop = np.minimum(stop, bounds[1:][text[begin]] - length)
    keep = valid[begin] & (stop >= begin)
    begin, stop = begin[keep], stop[keep]
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    found = [(none, none, none)]
    while len(begin):
        sample = begin + np.concatenate([views[begin[i:i + 8192]].argmin(axis=1) for i in range(0, len(begin), 8192)])
        to = np.minimum(stop, sample)
        found.append((sample, begin, to))
        more = stop > sample
        begin, stop = sample[more] + 1, stop[more]
    sample, begin, stop = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(begin, kind="stable")
    sample, begin, stop = sample[order], begin[order], stop[order]
    second = _names(_sums(data, _SECOND, _BASE2), powers(_INVERSE2, n + 1), begin, stop + length)
    second = mixed(second + ((sample - begin) * 65536 + (stop - begin)).astype(np.uint64))
    after = _names(sums, inverse, np.minimum(sample + k, n), np.minimum(sample + k + half, n)) & np.uint64(_SHORT)
    before = _names(sums, inverse, np.maximum(sample - half, 0), sample) & np.uint64(_SHORT)
    return grams[sample], second, text[begin], sample, begin, stop, after.astype(np.int64), before.astype(np.int64)


def _some_bytes(parts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Runs of pieces of about ``_TOGETHER`` bytes, within which repeated names are found before the shuffle."""
    run, size = [], 0
    for part in parts:
        run.append(part)
        size += len(part[1])
        if size >= _TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


def _rank(batch: pa.RecordBatch) -> np.ndarray:
    """The place of each row in the order of (doc, tie)."""
    rank = np.empty(batch.num_rows, np.int64)
    rank[np.lexsort((batch.column("tie").to_numpy(), batch.column("doc").to_numpy()))] = np.arange(batch.num_rows)
    return rank


def _in_order(rank: np.ndarray, text: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Arrays that are in order within each text, by the rank of the texts."""
    by = rank[text]
    if (by[1:] >= by[:-1]).all():
        return [text, *others]
    order = np.argsort(by, kind="stable")
    return [text[order], *[x[order] for x in others]]


def _repeats(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether a pair of names occurs earlier in the arrays."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    again = np.zeros(len(order), bool)
    again[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return again


def _merged(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans that are ordered by (text, start) and of which none holds a later one."""
    if not len(text):
        return text, start, end
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return text[at], start[at], np.maximum.reduceat(end, at)


def _first_level(texts: DataFrame, length: int) -> DataFrame:
    """(doc, tie, start, end, unsure): repeated spans, and the windows start .. end - 1 to be looked at.

    ``place`` packs where a sample's windows start, how far the sample is from there, how many windows there are
    after the first, and the short names; it is negative for spans that are known already.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = _rank(batch)
            doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            for pieces_ in _some_bytes(pieces(batch.column("text"))):
                parts = []
                for row, data, bounds in pieces_:
                    prefix, whole, text, at, begin, stop, after, before = _samples(data, bounds, length)
                    start = begin - bounds[text]
                    place = (((start << 7 | at - begin) << 7 | stop - begin) << 9 | after) << 9 | before
                    parts.append((prefix, whole, text + row, start, start + stop - begin, place))
                prefix, whole, text, begin, stop, place = (np.concatenate(x) for x in zip(*parts))
                text, prefix, whole, begin, stop, place = _in_order(rank, text, prefix, whole, begin, stop, place)
                again = _repeats(prefix, whole)
                known, start, end = _merged(text[again], begin[again], stop[again] + length)
                one = ~again
                text = np.concatenate((text[one], known))
                yield pa.record_batch(
                    [pa.array(np.concatenate((prefix[one], mixed(doc[known].view(np.uint64) + start.astype(np.uint64)))).view(np.int64)),
                     pa.array(np.concatenate((whole[one].view(np.int64), end))), pa.array(doc[text]), pa.array(tie[text]),
                     pa.array(np.concatenate((place[one], -start - 1)))],
                    names=["prefix", "whole", "doc", "tie", "place"])

    half = _width(length) // 2
    ranked = texts.mapInArrow(
        sample, "prefix bigint, whole bigint, doc bigint, tie bigint, place bigint"
    ).repartition("prefix").selectExpr(  # one shuffle of these columns for all windows that follow
        "*", "row_number() OVER (PARTITION BY prefix, whole, place < 0 ORDER BY doc, tie, place) AS turn",
        "shiftright(place, 9) & 511 AS after", "place & 511 AS before", "CAST(shiftright(place, 32) AS INT) AS start",
        "CAST(shiftright(place, 25) & 127 AS INT) AS ahead", "CAST(shiftright(place, 18) & 127 AS INT) AS more"
    ).selectExpr(
        "*", "min(whole) OVER (PARTITION BY prefix, after) <> max(whole) OVER (PARTITION BY prefix, after) AS near",
    ).selectExpr(
        "*", "min(whole) OVER (PARTITION BY prefix, before) <> max(whole) OVER (PARTITION BY prefix, before) AS far")
    # Windows from ``bend`` on begin within half the width before the sample.
    bend = f"greatest(start, start + ahead - {half - 1})"
    found = ranked.where("place < 0 OR turn > 1 OR near OR far").selectExpr("doc", "tie", f"""
        CASE WHEN place < 0 THEN array(named_struct('start', CAST(-place - 1 AS INT), 'end', CAST(whole AS INT), 'unsure', false))
             WHEN turn > 1 THEN array(named_struct('start', start, 'end', start + more + {length}, 'unsure', false))
             ELSE array(named_struct('start', start, 'end', IF(far, least({bend}, start + more + 1), start), 'unsure', true),
                        named_struct('start', {bend}, 'end', IF(near, start + more + 1, {bend}), 'unsure', true)) END AS spans""")
    return found.selectExpr("doc", "tie", "inline(spans)").where("start < end")


def _second_level(texts: DataFrame, unsure: DataFrame, length: int) -> DataFrame:
    """(doc, tie, start, end) of repeated windows among those that are unsure."""
    wanted = unsure.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    bits = bitmap(unsure.select("doc", "tie").distinct().select(F.xxhash64("doc", "tie").alias("hash")))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = _rank(batch)
            doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            ranges = batch.column("ranges")
            limits = ranges.offsets.to_numpy()
            low, high = (ranges.values.field(c).to_numpy() for c in ("start", "end"))
            for pieces_ in _some_bytes(pieces(batch.column("text"))):
                parts = []
                for row, data, bounds in pieces_:
                    n = len(data)
                    a, b = limits[row], limits[row + len(bounds) - 1]
                    text = np.repeat(np.arange(len(bounds) - 1), np.diff(limits[row:row + len(bounds)]))
                    order = np.lexsort((low[a:b], text))
                    text, begin, size = text[order], low[a:b][order], (high[a:b] - low[a:b])[order]
                    at = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                    text = np.repeat(text, size)
                    place = at + bounds[text]
                    one = _names(_sums(data, _FIRST, BASE), powers(INVERSE, n + 1), place, place + length)
                    two = _names(_sums(data, _SECOND, _BASE2), powers(_INVERSE2, n + 1), place, place + length)
                    parts.append((one, two, text + row, at))
                one, two, text, at = (np.concatenate(x) for x in zip(*parts))
                text, one, two, at = _in_order(rank, text, one, two, at)
                again = _repeats(one, two)
                known, start, end = _merged(text[again], at[again], at[again] + length)
                new = ~again
                text = np.concatenate((text[new], known))
                yield pa.record_batch(
                    [pa.array(np.concatenate((one[new], mixed(doc[known].view(np.uint64) + start.astype(np.uint64)))).view(np.int64)),
                     pa.array(np.concatenate((two[new].view(np.int64), np.zeros(len(known), np.int64)))),
                     pa.array(doc[text]), pa.array(tie[text]), pa.array(np.concatenate((at[new], start)), pa.int32()),
                     pa.array(np.concatenate((np.zeros(new.sum(), np.int64), end)), pa.int32())],
                    names=["one", "two", "doc", "tie", "start", "end"])

    chosen = texts.withColumn("hash", F.xxhash64("doc", "tie")).mapInArrow(
        _sifted(bits, True), "doc bigint, tie bigint, text string")
    windows = chosen.join(wanted, ["doc", "tie"]).mapInArrow(
        name, "one bigint, two bigint, doc bigint, tie bigint, start int, end int")
    return (
        windows.selectExpr("*", "row_number() OVER (PARTITION BY one, two, end > 0 ORDER BY doc, tie, start) AS place")
        .where("place > 1 OR end > 0")
        .select("doc", "tie", "start", F.expr(f"IF(end > 0, end, start + {length})").alias("end")))


def _sifted(bits: np.ndarray, inside: bool):
    """The rows whose ``hash`` may have a counterpart, or those that have none, without the hash."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pa.array(passes(bits, batch.column("hash").to_numpy().view(np.uint64)) == inside))
            yield rows.select([c for c in rows.schema.names if c != "hash"])

    return sift


def _cut(rows: DataFrame, id_col: str, bits: np.ndarray | None = None) -> DataFrame:
    """The result rows: spans united and cut out.

    With ``bits`` those of the rows whose ``hash`` has no counterpart; they have no spans. They are sifted by the worker that
    cuts them, as each step of its own would be a second worker for each running task.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if bits is not None:
            batches = _sifted(bits, False)(batches)
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            size, removed, spans, kept = [], [], [], []
            starts = batch.column("spans") if bits is None else None
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                found = starts[i].values if starts is not None else None
                deep = np.zeros(len(data) + 1, np.int32)
                if found is not None:
                    np.add.at(deep, found.field("start").to_numpy(), 1)
                    np.add.at(deep, found.field("end").to_numpy(), -1)
                gone = np.cumsum(deep)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                size.append(len(data))
                removed.append(int(gone.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                kept.append(data[~gone].tobytes())
            yield pa.record_batch(
                [batch.column("id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "spans", "kept"])

    return rows.mapInArrow(
        cut, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept binary")
