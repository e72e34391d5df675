"""Hard negatives by exact integer scores, computed with the Four-Russians method."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gradebook.sources.checkpoints import written_once

#: Most anchors and candidates of one block (the fewest, where more tasks would run at once), and of the pieces in which it is worked on.
ANCHORS, CANDIDATES, LEAST_CANDIDATES = 2048, 65536, 256
_FEW_ANCHORS, _FEW_CANDIDATES = 64, 2048


def hard_negatives(
    rows: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = 256, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """For each anchor and each of its best positives, the best rows of other labels in a band below the positive.

    A component x becomes floor(scale * x); a score is the integer inner product with the
    anchor (the components that the shorter vector lacks count as 0). Higher scores come first, ties by
    smaller id. Positives are the first ``n_positives`` other rows of the anchor's label; negatives of
    a positive are the first ``n_negatives`` rows of other labels with
    low * positive <= 100 * negative <= high * positive.

    Method: candidates are stored as packed bit planes, eight dimensions to a byte
    (two's complement). For every anchor and group of eight dimensions a table holds all 256
    subset sums; a plane's score is a sum of lookups, and planes are added by
    shifting. Anchors and candidates are dealt in blocks; each pair of blocks
    returns only its best rows per anchor (and positive), which are then ranked.

    ``anchors`` is the condition that makes a row an anchor; every usable row is a candidate. Rows with a
    null id, label or vector, or a null or non-finite component, take no part. Rows
    equal in id, label and scaled vector count once; rows that share only the id
    are rows of their own, but never each other's positives. A scaled component whose
    products do not fit 62 bits ends the job with an error. Other columns are not looked at.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    vectors = written_once(_scaled(rows, anchors, id_col, vector_col, label_col, scale), "vectors")
    facts = vectors.agg(
        F.count("*").alias("n"), F.sum(F.col("anchor").cast("int")).alias("anchors"), F.max(F.size("q")).alias("dim"),
        F.min(F.array_min("q")).alias("least"), F.max(F.array_max("q")).alias("most")).first()
    kind = vectors.schema["id"].dataType.simpleString()
    out = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score bigint, negative_score bigint"
    if not facts["anchors"] or not facts["dim"]:
        return rows.sparkSession.createDataFrame([], out)
    dim, most = facts["dim"], max(-facts["least"], facts["most"] + 1)
    if most * most * dim >= 2**62:
        raise ValueError("a component is too large for exact scores in 64 bits")
    planes = int(most).bit_length() + 1
    small = most * most * dim < 2**30

    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-facts["n"] // CANDIDATES), min(slots, -(-facts["n"] // LEAST_CANDIDATES)))
    anchor_blocks = -(-facts["anchors"] // ANCHORS)
    place = F.xxhash64("id", "copy")
    candidates = written_once(_packed(vectors, dim, planes).withColumn("block", F.pmod(place, F.lit(blocks)).cast("int")), "candidates")
    asked = (
        vectors.where("anchor").select("id", "copy", "label", "q")
        .withColumn("anchor_block", F.pmod(F.shiftright(place, 7), F.lit(anchor_blocks)).cast("int")))

    def cells(frame: DataFrame, column: str, n: int) -> DataFrame:
        return frame.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).groupBy("anchor_block", "block")

    def positives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_positives(left, right, n_positives, dim, planes, small)

    partial = cells(asked, "block", blocks).cogroup(cells(candidates, "anchor_block", anchor_blocks)).applyInArrow(
        positives_of, f"id {kind}, copy int, other {kind}, other_copy int, score bigint")
    best = F.row_number().over(_window("id", "copy", order=["other", "other_copy"]))
    positives = written_once(partial.withColumn("place", best).where(F.col("place") <= n_positives), "positives")

    bands = positives.groupBy("id", "copy").agg(F.sort_array(F.collect_list(F.struct("place", "other", "score"))).alias("p"))
    with_bands = written_once(asked.join(bands, ["id", "copy"]).select(
        "id", "copy", "label", "q", "anchor_block", F.col("p.score").alias("scores")), "asked")

    def negatives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_negatives(left, right, n_negatives, low, high, dim, planes, small)

    found = cells(with_bands, "block", blocks).cogroup(cells(candidates, "anchor_block", anchor_blocks)).applyInArrow(
        negatives_of, f"id {kind}, copy int, place int, other {kind}, other_copy int, score bigint")
    rank = F.row_number().over(_window("id", "copy", "place", order=["other", "other_copy"]))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= n_negatives).withColumnsRenamed({"other": "negative_id", "score": "negative_score"})
    return ranked.join(positives.withColumnsRenamed({"other": "positive_id", "score": "positive_score"}).drop("other_copy"), ["id", "copy", "place"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _window(*keys: str, order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.desc("score"), *order)


def _scaled(rows: DataFrame, anchors: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, q, anchor, copy) of the usable rows, each distinct one once; ``copy`` numbers those that share an id."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = rows.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"))
    usable = usable.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    limit = F.lit(float(2**31))
    # Beyond 2^31 the products do not fit; the size is kept, so that the check for it sees it.
    q = F.transform("v", lambda x: F.floor(F.least(limit, F.greatest(-limit, x * scale))).cast("bigint"))
    same_id = Window.partitionBy("id").orderBy("label", "q", "anchor")
    return (
        usable.select("id", "label", q.alias("q"), "anchor")
        .withColumn("copy", F.dense_rank().over(same_id).cast("int")).dropDuplicates(["id", "copy"]))


def _packed(vectors: DataFrame, dim: int, planes: int) -> DataFrame:
    """(id, copy, label, bits): ``planes`` planes of one byte per eight dimensions, lowest plane first."""
    groups = -(-dim // 8)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                q = _matrix(part.column("q"), groups * 8)
                bits = np.stack([np.packbits(((q >> p) & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes)], axis=1)
                flat = np.ascontiguousarray(bits).reshape(len(q), planes * groups)
                packed = pa.Array.from_buffers(
                    pa.binary(), len(q), [None, pa.py_buffer(np.arange(len(q) + 1, dtype=np.int32) * (planes * groups)), pa.py_buffer(flat)])
                yield pa.record_batch([part.column("id"), part.column("copy"), part.column("label"), packed], names=["id", "copy", "label", "bits"])

    return vectors.select("id", "copy", "label", "q").mapInArrow(pack, f"id {kinds['id']}, copy int, label {kinds['label']}, bits binary")


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Integer vectors as rows, padded with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = lists.flatten().to_numpy()
    return out


def _tables(q: np.ndarray, kind: type) -> np.ndarray:
    """Subset sums of every group of eight dimensions: [group, byte, anchor]."""
    parts = q.astype(kind).reshape(len(q), -1, 8).transpose(1, 2, 0)
    sums = np.zeros((parts.shape[0], 256, len(q)), kind)
    for d in range(8):
        sums[:, 1 << d:2 << d] = sums[:, :1 << d] + parts[:, d:d + 1]
    return sums


def _scores(tables: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Scores [candidate, anchor] of packed candidates [candidate, plane, group]; the top plane is negative."""
    _, planes, groups = bits.shape
    total = np.zeros((len(bits), tables.shape[2]), tables.dtype)
    one = np.empty_like(total)
    for plane in range(planes - 1, -1, -1):
        total <<= 1
        for group in range(groups):
            np.take(tables[group], bits[:, plane, group], axis=0, out=one, mode="clip")
            if plane == planes - 1:
                total -= one
            else:
                total += one
    return total


class _Block:
    """Candidates of a block, in order of (id, copy), and their packed bits."""

    def __init__(self, rows: pa.Table, dim: int, planes: int) -> None:
        rows = rows.sort_by([("id", "ascending"), ("copy", "ascending")]).combine_chunks()
        self.ids, self.copies, self.labels = (rows.column(c).combine_chunks() for c in ("id", "copy", "label"))
        packed = rows.column("bits").combine_chunks()
        whole = packed.buffers()[2] if len(packed) else b""
        self.bits = np.frombuffer(whole, np.uint8)[:len(packed) * planes * -(-dim // 8)].reshape(len(packed), planes, -(-dim // 8))


def _codes(left: pa.ChunkedArray | pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Equal values of two columns get equal numbers."""
    both = pa.chunked_array([*(left.chunks if isinstance(left, pa.ChunkedArray) else [left]), right])
    codes = both.combine_chunks().dictionary_encode().indices.to_numpy()
    return codes[:len(left)], codes[len(left):]


def _best_positives(anchors: pa.Table, candidates: pa.Table, count: int, dim: int, planes: int, small: bool) -> pa.Table:
    """The best ``count`` candidates of each anchor's label in one block."""
    block = _Block(candidates, dim, planes)
    anchors = anchors.combine_chunks()
    of_anchor, of_row = _codes(anchors.column("label"), block.labels)
    id_of_anchor, id_of_row = _codes(anchors.column("id"), block.ids)
    q = _matrix(anchors.column("q").combine_chunks(), -(-dim // 8) * 8)
    a_at, c_at, scores = [], [], []
    for label in np.unique(of_anchor):
        mine, rows = np.flatnonzero(of_anchor == label), np.flatnonzero(of_row == label)
        for s in range(0, len(mine), _FEW_ANCHORS):
            some = mine[s:s + _FEW_ANCHORS]
            tables = _tables(q[some], np.int32 if small else np.int64)
            best = [np.zeros((0, 2), np.int64) for _ in some]
            for t in range(0, len(rows), _FEW_CANDIDATES):
                part = rows[t:t + _FEW_CANDIDATES]
                got = _scores(tables, block.bits[part])
                for k, anchor in enumerate(some):
                    other = np.flatnonzero(id_of_row[part] != id_of_anchor[anchor])
                    both = np.concatenate([best[k], np.stack([part[other], got[other, k]], axis=1)])
                    best[k] = both[np.argsort(-both[:, 1], kind="stable")[:count]]
            for k, anchor in enumerate(some):
                a_at.append(np.full(len(best[k]), anchor))
                c_at.append(best[k][:, 0])
                scores.append(best[k][:, 1])
    a_at, c_at, scores = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a_at, c_at, scores))
    return pa.table({
        "id": anchors.column("id").take(a_at), "copy": anchors.column("copy").take(a_at),
        "other": block.ids.take(pa.array(c_at)), "other_copy": block.copies.take(pa.array(c_at)), "score": pa.array(scores)})


def _best_negatives(anchors: pa.Table, candidates: pa.Table, count: int, low: int, high: int, dim: int, planes: int, small: bool) -> pa.Table:
    """For each anchor and positive score the best ``count`` candidates of other labels inside the band, in one block."""
    block = _Block(candidates, dim, planes)
    anchors = anchors.combine_chunks()
    of_anchor, of_row = _codes(anchors.column("label"), block.labels)
    asked = anchors.column("scores").to_pylist()
    q = _matrix(anchors.column("q").combine_chunks(), -(-dim // 8) * 8)
    a_at, places, c_at, scores = [], [], [], []
    for s in range(0, len(anchors), _FEW_ANCHORS):
        some = np.arange(s, min(s + _FEW_ANCHORS, len(anchors)))
        # A score x is in the band of p if ceil(low p / 100) <= x <= floor(high p / 100).
        bands = [[(-(-low * p // 100), high * p // 100) for p in asked[a]] for a in some]
        best = [[np.zeros((0, 2), np.int64) for _ in b] for b in bands]
        tables = _tables(q[some], np.int32 if small else np.int64)
        for t in range(0, len(block.bits), _FEW_CANDIDATES):
            got = _scores(tables, block.bits[t:t + _FEW_CANDIDATES])
            differs = of_row[t:t + _FEW_CANDIDATES][:, None] != of_anchor[some][None, :]
            for k in range(len(some)):
                if not bands[k]:
                    continue
                floor = min(b[0] for b in bands[k])
                at = np.flatnonzero(differs[:, k] & (got[:, k] >= floor))
                at = at[np.argsort(-got[at, k].astype(np.int64), kind="stable")]
                value = got[at, k].astype(np.int64)
                for j, (least, most) in enumerate(bands[k]):
                    a, b = np.searchsorted(-value, -most, "left"), np.searchsorted(-value, -least, "right")
                    if a < b:
                        take = slice(a, min(b, a + count))
                        both = np.concatenate([best[k][j], np.stack([at[take] + t, value[take]], axis=1)])
                        best[k][j] = both[np.argsort(-both[:, 1], kind="stable")[:count]]
        for k, anchor in enumerate(some):
            for j, rows in enumerate(best[k]):
                a_at.append(np.full(len(rows), anchor))
                places.append(np.full(len(rows), j + 1))
                c_at.append(rows[:, 0])
                scores.append(rows[:, 1])
    a_at, places, c_at, scores = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a_at, places, c_at, scores))
    return pa.table({
        "id": anchors.column("id").take(a_at), "copy": anchors.column("copy").take(a_at), "place": pa.array(places.astype(np.int32)),
        "other": block.ids.take(pa.array(c_at)), "other_copy": block.copies.take(pa.array(c_at)), "score": pa.array(scores)})
