"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gradebook.llm.names import unused
from gradebook.llm.tokens import mixed
from gradebook.operators.graphs import components
from gradebook.sources.checkpoints import written_once


class Hashing(NamedTuple):
    """``tables`` keys per vector, each of ``depth`` projections in steps of ``width``.

    A normalised pair of cosine 0.98 lies 0.2 apart, shares one step of width 1 with
    probability 0.84 and so meets in one of 40 tables with 1 - (1 - 0.84^10)^40 = 0.9995;
    closer pairs meet more often. Unrelated vectors share a key with about 0.000002.
    """

    tables: int = 40
    depth: int = 10
    width: float = 1.0
    seed: int = 13


#: Vectors on either side of a tile; a tile's vectors are in memory together.
TILE = 512
#: Taken off or added to angles where a bound has to be safe against rounding.
_SLACK = 1e-6


def near_vectors(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = 0.98, hashing: Hashing = Hashing(),
) -> DataFrame:
    """Links and components of vectors of one label whose cosine is ``cosine`` or more.

    Method: equal vectors of a label are one node. Every node has one key per table:
    its normalised vector's steps on random Gaussian lines. Nodes within half the
    limit's angle of a pivot of their buckets form a ball, in which all are linked for certain.
    In buckets that hold several balls, the nodes outside the largest are compared
    with one another and, unless its distance rules it out, with the largest, in
    tiles of bounded size, by exact cosines in double precision. A pair counts in the first
    table in which it meets, and only sums per node and one label per ball leave a tile.

    One row per row of ``rows``: id, n_links (other rows linked directly, copies
    included), component_id (smallest id reachable), kept (id = component_id). Rows
    with a null label, and vectors that are null, empty, zero or hold a null or
    non-finite component, are linked with nothing; so are vectors of different
    length. Rows that repeat an id count as rows of their own. A null id is never
    the smallest unless its component has no other. Other columns are not looked at.
    """
    vector = F.col(vector_col)
    if rows.schema[vector_col].dataType != ArrayType(FloatType()):
        vector = vector.cast("array<double>")
    plain = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vec"))
    nodes = written_once(
        plain.where(_usable("vec") & F.col("label").isNotNull()).groupBy("label", "vec")
        .agg(F.count("*").alias("n"), F.min("id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = written_once(_keyed(nodes, hashing), "keyed")
    members = written_once(_members(keyed), "members")
    balls = written_once(_balls(keyed, members, cosine), "balls")
    found = written_once(_compared(keyed, members, balls, cosine), "found")

    more = found.groupBy("node").agg(F.sum("links").alias("more"))
    roots = components(found.select(F.col("ball").alias("u"), F.col("low").alias("v")).distinct())
    placed = written_once(
        nodes.join(balls.select("node", "ball"), "node").join(more, "node", "left")
        .join(roots.select(F.col("node").alias("ball"), "root"), "ball", "left")
        .withColumn("root", F.coalesce("root", "ball")), "placed")
    # Written first, so that a join can split the rows of a large ball or component.
    weight = written_once(balls.groupBy("ball").agg(F.sum("n").alias("weight")), "weight")
    least = written_once(placed.groupBy("root").agg(F.min("least").alias("component")), "least")
    answer = written_once(
        placed.join(weight, "ball").join(least, "root")
        .select("label", "vec", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component"), "answer")
    return (
        plain.join(answer, ["label", "vec"], "left")
        .select(
            F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def without_near_vectors(rows: DataFrame, *, id_col: str = "vec_id", **options) -> DataFrame:
    """The rows of ``rows`` that keep their id as the component's, with all columns; all rows of such an id stay."""
    name = unused(rows, "_kept_id")
    stays = near_vectors(rows, id_col=id_col, **options).where("kept").select(F.col(id_col).alias(name)).distinct()
    return rows.join(stays, rows[id_col].eqNullSafe(stays[name]), "left_semi")


def _usable(vec: str) -> Column:
    """Whether a vector has only finite components and not only zeros."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _keyed(nodes: DataFrame, hashing: Hashing) -> DataFrame:
    """(node, label, dim, n, vec, norm, keys): vectors scaled by a power of two, so that squares fit.

    That is exact but for components 2^126 times smaller than the largest, which are lost in the sums as well.
    """
    tables, depth, width, seed = hashing

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            vectors = batch.column("vec")
            dims = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = part.column("vec").flatten().to_numpy().astype(np.float64).reshape(-1, dim)
                x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
                norm = np.sqrt((x * x).sum(axis=1))
                if dim not in lines:
                    random = np.random.default_rng([seed, dim])
                    lines[dim] = random.standard_normal((dim, tables * depth)), random.uniform(0, width, tables * depth)
                line, offset = lines[dim]
                step = np.floor((x / norm[:, None] @ line + offset) / width).astype(np.int64).view(np.uint64)
                keys = np.tile(mixed(np.arange(tables, dtype=np.uint64)), (len(x), 1))
                for j in range(depth):
                    keys = mixed(keys + step.reshape(-1, tables, depth)[:, :, j])
                yield pa.record_batch(
                    [part.column("node"), part.column("label"), pa.array(np.full(len(x), dim, np.int32)), part.column("n"),
                     _lists(x.astype(vectors.type.value_type.to_pandas_dtype())), pa.array(norm), _lists(keys.view(np.int64))],
                    names=["node", "label", "dim", "n", "vec", "norm", "keys"])

    label, vec = (nodes.schema[c].dataType.simpleString() for c in ("label", "vec"))
    return nodes.select("node", "label", "n", "vec").mapInArrow(
        key, f"node bigint, label {label}, dim int, n bigint, vec {vec}, norm double, keys array<bigint>")


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.reshape(-1)))


def _members(keyed: DataFrame) -> DataFrame:
    """(bucket, table, node, pivot) of the buckets that several nodes share; the pivot is the one of the smallest hash."""
    entries = keyed.select("node", "label", "dim", F.posexplode("keys").alias("table", "key"))
    bucket = ["label", "dim", "table", "key"]
    buckets = written_once(
        entries.groupBy(bucket).agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node"), "node")).alias("p"))
        .where("size > 1").select(*bucket, F.col("p.node").alias("pivot"))
        .withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    return entries.join(buckets, bucket).select("bucket", "table", "node", "pivot")


def _angles(pairs: DataFrame, keyed: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the angle of the nodes in the columns ``a`` and ``b``."""
    of = lambda c, v, n: keyed.select(F.col("node").alias(c), F.col("vec").alias(v), F.col("norm").alias(n))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / (F.col("nx") * F.col("ny"))))
    return pairs.join(of(a, "x", "nx"), a).join(of(b, "y", "ny"), b).withColumn("angle", F.acos(cosine)).drop("x", "y", "nx", "ny")


def _balls(keyed: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """(node, n, ball, angle): the pivot of the smallest hash within half the limit's angle, or the node itself."""
    half = math.acos(cosine) / 2 - _SLACK
    pairs = members.where("node <> pivot").select("node", "pivot").distinct()
    near = (
        _angles(pairs, keyed, "node", "pivot").where(F.col("angle") <= half)
        .groupBy("node").agg(F.min(F.struct(F.xxhash64("pivot").alias("h"), "pivot", "angle")).alias("p")))
    return keyed.select("node", "n").join(near, "node", "left").select(
        "node", "n", F.coalesce("p.pivot", "node").alias("ball"), F.coalesce("p.angle", F.lit(0.0)).alias("angle"))


def _compared(keyed: DataFrame, members: DataFrame, balls: DataFrame, cosine: float) -> DataFrame:
    """(node, ball, links, low): links to nodes of other balls, and the smallest ball a tile connects them with."""
    met = written_once(members.select("bucket", "table", "node").join(balls.select("node", "ball"), "node"), "met")
    mixed_buckets = written_once(
        met.groupBy("bucket", "ball").agg(F.count("*").alias("size")).groupBy("bucket")
        .agg(F.count("*").alias("balls"), F.max(F.struct("size", "ball")).alias("m"))
        .where("balls > 1").select("bucket", F.col("m.ball").alias("main")), "mixed")
    open_rows = met.join(mixed_buckets, "bucket")
    few = written_once(open_rows.where("ball <> main"), "few")
    # A node further from the main ball's centre than the limit and the ball's radius is linked with none of it.
    radius = balls.groupBy("ball").agg(F.max("angle").alias("radius"))
    reach = (
        _angles(few.select("node", "main").distinct(), keyed, "node", "main")
        .join(radius.withColumnRenamed("ball", "main"), "main")
        .where(F.col("angle") <= math.acos(cosine) + F.col("radius") + _SLACK).select("node", "main"))
    near = few.join(reach, ["node", "main"], "left_semi").select("bucket").distinct()
    columns = few.select("bucket", "table", "node", F.lit(True).alias("few")).unionByName(
        open_rows.where("ball = main").join(near, "bucket", "left_semi").select("bucket", "table", "node", F.lit(False).alias("few")))
    columns = written_once(columns, "columns")
    sizes = written_once(
        columns.groupBy("bucket").agg(F.sum(F.col("few").cast("int")).alias("f"), F.count("*").alias("c")).where("c > 1")
        .select("bucket", F.ceil(F.col("f") / TILE).cast("int").alias("rows"), F.ceil(F.col("c") / TILE).cast("int").alias("cols")), "sizes")
    sized = columns.join(sizes, "bucket")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sized.where("few").withColumn("i", place("rows")).withColumn("j", every("cols")).withColumn("side", F.lit(0))
    right = sized.withColumn("j", place("cols")).withColumn("i", every("rows")).withColumn("side", F.lit(1))
    use = ["bucket", "table", "i", "j", "side", "few", "node"]
    tiles = (
        left.select(use).unionByName(right.select(use)).join(balls.select("node", "ball"), "node")
        .join(keyed.select("node", "n", "vec", "norm", "keys"), "node")
        .withColumn("keys", F.slice("keys", F.lit(1), F.col("table"))))
    tile = ["bucket", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*waiting, batch]).combine_chunks()
            at = np.stack([rows.column(c).to_numpy() for c in tile])
            begin = np.flatnonzero(np.concatenate(([True], (at[:, 1:] != at[:, :-1]).any(axis=0)))) if rows.num_rows else []
            for a, b in zip(begin[:-1], begin[1:]):
                yield from _links_of(rows.slice(a, b - a), cosine)
            waiting = rows.slice(begin[-1]).to_batches() if len(begin) else []
        if waiting:
            yield from _links_of(pa.Table.from_batches(waiting).combine_chunks(), cosine)

    return (
        tiles.repartition(*tile).sortWithinPartitions(*tile)
        .mapInArrow(compare, "node bigint, ball bigint, links bigint, low bigint"))


def _links_of(rows: pa.Table, cosine: float) -> Iterator[pa.RecordBatch]:
    """Links of a tile between nodes of different balls that meet in no earlier table."""
    side, few, node, ball, n, norm = (rows.column(c).to_numpy() for c in ("side", "few", "node", "ball", "n", "norm"))
    table = rows.column("table")[0].as_py()
    x = rows.column("vec").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(node), -1)
    keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), table)
    l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    linked = (x[l] @ x[r].T / np.outer(norm[l], norm[r]) >= cosine) & (ball[l][:, None] != ball[r][None, :])
    a, b = np.nonzero(linked)
    if table and len(a):
        earlier = np.zeros(len(a), bool)
        for s in range(0, len(a), 1 << 16):
            p, q = l[a[s:s + (1 << 16)]], r[b[s:s + (1 << 16)]]
            earlier[s:s + (1 << 16)] = (keys[p] == keys[q]).any(axis=1)
        linked[a[earlier], b[earlier]] = False
    if not linked.any():
        return
    # A few node is a row wherever it is a column, so its own row counts; members of the main ball are columns only.
    counts = linked @ n[r], np.where(few[r], 0, linked.T @ n[l])
    low = [ball[l].copy(), ball[r].copy()]
    most = np.iinfo(np.int64).max
    while True:
        rows_low = np.minimum(low[0], np.where(linked, low[1][None, :], most).min(axis=1, initial=most))
        cols_low = np.minimum(low[1], np.where(linked, rows_low[:, None], most).min(axis=0, initial=most))
        if (rows_low == low[0]).all() and (cols_low == low[1]).all():
            break
        low = [rows_low, cols_low]
    for at, count, least, has in ((l, counts[0], low[0], linked.any(axis=1)), (r, counts[1], low[1], linked.any(axis=0))):
        yield pa.record_batch(
            [pa.array(node[at][has]), pa.array(ball[at][has]), pa.array(count[has].astype(np.int64)), pa.array(least[has])],
            names=["node", "ball", "links", "low"])
