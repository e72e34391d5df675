"""MinHash near-duplicates with tensored banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.llm.bitmaps import bitmap, passes
from gradebook.llm.names import unused
from gradebook.llm.tokens import NOT_SPACE, mixed, pieces, shingles, words_of
from gradebook.operators.graphs import components
from gradebook.sources.checkpoints import kept_table, passing_tables, written_once


class Banding(NamedTuple):
    """Two collections of ``side`` sub-keys of ``depth`` minhashes each make ``side ** 2`` tables.

    The default computes 72 minhashes for 144 tables of six. A pair of similarity
    0.8 meets in no table with probability 2 (1 - 0.8^3)^12 = 0.0004, one of 0.85
    with 0.00002; members of a larger group meet by many pairs.
    """

    side: int = 12
    depth: int = 3


#: Nodes on either side of a tile in which sets are compared; a tile's sets are in memory together.
TILE = 512


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
    banding: Banding = Banding(),
) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least ``percent`` hundredths.

    Words are runs of characters other than space, tab and line ends, A-Z
    lower-cased; a document's set holds its distinct ``shingle``-word sequences,
    or its whole sequence if that is shorter. A document without words has an
    empty set and is linked with nothing.

    Method: equal sets are one node. The keys of the tables are all pairs of one
    sub-key of either collection. Nodes with too many shingles of their own to be linked with
    any other leave at once. Each other node is compared with the one node that it meets first in most
    tables; then the nodes that share a table and still lie in
    different components are compared in tiles of bounded size. Pairs inside one
    component cannot change the result and are skipped. Links are confirmed on the full sets.

    One row per row of ``docs``: id, ``row_hash`` (xxhash64 of id and text), n_shingles,
    ``component`` (a number of the component, null for an empty set), component_id
    (smallest id of the component), kept (id = component_id). Rows are judged on
    their own text: rows that share an id are linked only if their texts are. A null id
    is never the smallest unless the component has no other. Other columns are not looked at.
    """
    signatures = written_once(_signatures(docs, id_col, text_col, shingle, banding), "signatures")
    with passing_tables(docs.sparkSession):
        answer = kept_table(_answer(docs, signatures, id_col, text_col, shingle, percent, banding), "components")
    return (
        signatures.select("id", "row_hash", "s1", "s2", "n_shingles").join(answer, ["s1", "s2"], "left")
        .select(
            F.col("id").alias(id_col), "row_hash", "n_shingles", F.col("root").alias("component"),
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def _answer(
    docs: DataFrame, signatures: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, banding: Banding,
) -> DataFrame:
    """(s1, s2, root, component_id) of every distinct set."""
    nodes = written_once(
        signatures.where("n_shingles > 0").groupBy("s1", "s2")
        .agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.min("id").alias("least"),
             F.min(F.struct("id", "row_hash")).alias("source"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = written_once(_tables(nodes, banding), "members")
    sets = written_once(_node_sets(docs, nodes, members, id_col, text_col, shingle), "sets")
    labels = _linked(members, sets, percent)

    rooted = written_once(
        nodes.select("s1", "s2", "node", "least").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = written_once(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return rooted.join(least, "root").select("s1", "s2", "root", "component_id")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component of ``docs``, and every document without words, with all columns.

    The one with the smallest id stays. Rows that repeat both id and text count once; of those that differ elsewhere
    the one of the smallest hash of all columns stays.
    """
    found = near_duplicates(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options).where("kept")
    one = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(id_col, "row_hash")).alias("one")).select("one.*")
    stays = one.unionByName(found.where("n_shingles = 0").select(id_col, "row_hash").distinct())
    key = unused(docs, "_row_hash")
    hashed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    same = (hashed[key] == stays["row_hash"]) & hashed[id_col].eqNullSafe(stays[id_col])
    rows = hashed.join(stays, same, "left_semi")
    whole = F.struct(*docs.columns)
    return rows.groupBy(key, id_col).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias(key + "_row")).select(f"{key}_row.*")


def _keys(h: np.ndarray, at: np.ndarray, banding: Banding) -> np.ndarray:
    """Sub-keys of the sets that begin at ``at``: one row per set, first one collection, then the other."""
    random = np.random.default_rng(61)
    count = 2 * banding.side * banding.depth
    factors = random.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = random.integers(0, 2**63, count, dtype=np.uint64)
    out = np.zeros((len(at), 2 * banding.side), np.uint64)
    for i in range(count):
        least = np.minimum.reduceat(h * factors[i] + offsets[i], at)
        out[:, i // banding.depth] = mixed(out[:, i // banding.depth] + least)
    return out


def _sets(data: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(data, bounds, NOT_SPACE)
    h, _ = shingles(words, k)
    short = {n: shingles(words, n)[0] for n in set(np.diff(words.first).tolist()) if 0 < n < k}
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        n = int(b - a)
        out.append(np.unique(h[a:b - k + 1]) if n >= k else short[n][a:a + 1] if n else h[:0])
    return out


def _signatures(docs: DataFrame, id_col: str, text_col: str, k: int, banding: Banding) -> DataFrame:
    """(id, row_hash of id and text, s1, s2: 128-bit hash of the set, n_shingles, keys) of every row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row_hash"))
    kind = source.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in pieces(batch.column("text")):
                sets = _sets(data, bounds, k)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                keys = np.zeros((len(sets), 2 * banding.side), np.uint64)
                if len(full):
                    h = np.concatenate([sets[i] for i in full])
                    at = np.concatenate(([0], np.cumsum(size[full])[:-1]))
                    keys[full] = _keys(h, at, banding)
                    s1[full] = mixed(np.add.reduceat(mixed(h), at) + size[full].astype(np.uint64))
                    s2[full] = mixed(np.add.reduceat(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), at))
                flat = pa.array(keys.reshape(-1).view(np.int64))
                yield pa.record_batch(
                    [batch.column("id").slice(row, len(sets)), batch.column("row_hash").slice(row, len(sets)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                     pa.array(size), pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * (2 * banding.side), flat)],
                    names=["id", "row_hash", "s1", "s2", "n_shingles", "keys"])

    return source.mapInArrow(sign, f"id {kind}, row_hash bigint, s1 bigint, s2 bigint, n_shingles bigint, keys array<bigint>")


def _tables(nodes: DataFrame, banding: Banding) -> DataFrame:
    """(key, node) of all table entries that at least two nodes share.

    Of the entries of one key in one batch only the first meets those of other
    batches; the others are known to share it and are spread by their node. So a key
    holds at most one row per batch in the shuffle, however many nodes have it.
    """
    side = banding.side

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.arange(side * side, dtype=np.uint64).reshape(1, side, side)
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy().view(np.uint64).reshape(-1, 2 * side)
            node = batch.column("node").to_numpy()
            for a in range(0, len(node), 4096):
                part = keys[a:a + 4096]
                key = mixed(mixed(part[:, :side, None] + table) + part[:, None, side:]).reshape(-1).view(np.int64)
                order = np.argsort(key, kind="stable")
                key, owner = key[order], np.repeat(node[a:a + 4096], side * side)[order]
                again = np.concatenate(([False], key[1:] == key[:-1]))
                shared = again | np.concatenate((again[1:], [False]))
                yield pa.record_batch([pa.array(key), pa.array(owner * 4 + again * 2 + shared)], names=["key", "entry"])

    entries = nodes.select("node", "keys").mapInArrow(enter, "key bigint, entry bigint")
    return (
        entries.withColumn("others", F.expr(
            "count(*) OVER (PARTITION BY key, IF(entry & 2 = 2, shiftright(entry, 2) + 1, 0))"))
        .where("entry & 1 = 1 OR others > 1").select("key", F.shiftright("entry", 2).alias("node")))


def _node_sets(docs: DataFrame, nodes: DataFrame, members: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, n, items: shingle hashes) of the nodes in ``members``, from one text of each.

    A fixed-size bitmap of the chosen rows keeps most others out of the join.
    """
    chosen = members.select("node").distinct().join(nodes.select("node", "n", "source"), "node").select(
        "node", "n", F.col("source.row_hash").alias("row_hash"))
    bits = bitmap(chosen.select(F.col("row_hash").alias("hash")))
    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row_hash"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits, batch.column("row_hash").to_numpy().view(np.uint64))))
            for row, data, bounds in pieces(batch.column("text")):
                sets = _sets(data, bounds, k)
                yield pa.record_batch(
                    [batch.column("row_hash").slice(row, len(sets)),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["row_hash", "items"])

    sets = rows.mapInArrow(read, "row_hash bigint, items array<bigint>")
    return chosen.join(sets, "row_hash").where("size(items) = n").dropDuplicates(["node"]).select("node", "n", "items")


def _linked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the nodes that are linked with another."""
    # Shingles that no other node has bound what a node can share with any other. Nodes that cannot reach the limit leave here.
    own = (
        sets.select("node", F.explode("items").alias("item")).groupBy("item")
        .agg(F.count("*").alias("count"), F.min("node").alias("node")).where("count = 1")
        .groupBy("node").agg(F.count("*").alias("own")))
    facts = written_once(
        sets.select("node", "n").join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
        .where(100 * F.col("common") >= percent * F.col("n")), "facts")
    hopeful = members.join(facts, "node")
    # The pivot of a key: the node with the smallest share of shingles of its own.
    order = F.struct((-F.col("common") / F.col("n")).alias("r"), F.xxhash64("node").alias("h"), "node", "n", "common")
    pivots = written_once(
        hopeful.groupBy("key").agg(F.min(order).alias("p"), F.count("*").alias("size")).where("size > 1").select(
            "key", F.col("p.node").alias("b"), F.col("p.n").alias("n2"), F.col("p.common").alias("common2")), "pivots")
    shared = written_once(hopeful.join(pivots, "key").select("key", "node", "n", "common", "b", "n2", "common2"), "shared")
    best = (
        shared.where("node <> b").where(_may_link(percent)).groupBy("node", "b").agg(F.count("*").alias("keys"))
        .groupBy("node").agg(F.max(F.struct("keys", "b")).alias("m")).select(F.col("node").alias("a"), F.col("m.b").alias("b")))
    links = written_once(_confirmed(best, sets, percent), "links")
    labels = written_once(components(links), "labels")
    labelled = shared.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
    more = _tiled(_groups(written_once(labelled, "labelled")), sets, percent)
    return _joined(labels, components(more))


def _joined(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of components of components: nodes with their label, and labels that are linked with others."""
    moved = roots.select(F.col("node").alias("label"), F.col("root").alias("top"))
    known = labels.select("node", F.col("root").alias("label")).join(moved, "label", "left").select("node", F.coalesce("top", "label").alias("root"))
    alone = moved.select(F.col("label").alias("node"), F.col("top").alias("root")).join(labels, "node", "left_anti")
    return known.unionByName(alone)


def _groups(labelled: DataFrame) -> DataFrame:
    """(group, node, label, few, member): who has to be compared with whom; pairs of a ``few`` node and a member of its group.

    In a key whose nodes differ in label, those outside its largest label are few. They are compared with all
    nodes of that label, which is one group for all keys in which it is the largest, and with one another.
    Keys with the same few nodes are one group. So every pair of nodes that share a key and differ in label is compared.
    """
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("size"))
    several = written_once(
        sizes.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("size", "label")).alias("m")).where("labels > 1")
        .select("key", F.col("m.label").alias("main")), "several")
    few = written_once(labelled.join(several, "key").where("label <> main"), "few")
    visits = few.select(F.col("main").alias("group"), "node", "label").distinct().withColumns({"few": F.lit(True), "member": F.lit(False)})
    mains = written_once(few.select("main").distinct(), "mains")
    homes = (
        labelled.select("node", F.col("label").alias("main")).distinct().join(mains, "main")
        .select(F.col("main").alias("group"), "node", F.col("main").alias("label"), F.lit(False).alias("few"), F.lit(True).alias("member")))
    # Two sums of hashes name a set of few nodes.
    named = few.groupBy("key").agg(
        F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.sum(F.xxhash64("node").bitwiseAND(F.lit(2**40 - 1))).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND(F.lit(2**40 - 1))).alias("y"),
        F.bit_xor(F.xxhash64("node", F.lit(2))).alias("z")).where("low <> high")
    one = written_once(named.groupBy("size", "x", "y", "z").agg(F.min("key").alias("key")).select("key"), "few_keys")
    # Labels are numbers of nodes and from 0 on, so negative numbers are free for these groups.
    among = few.join(one.withColumn("group", -1 - F.monotonically_increasing_id()), "key").select(
        "group", "node", "label", F.lit(True).alias("few"), F.lit(True).alias("member"))
    return visits.unionByName(homes).unionByName(among)


def _tiled(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) labels of linked pairs of a few node and a member of its group.

    A group is cut into tiles of about ``TILE`` few nodes and as many members. A tile is compared in
    one task with bounded memory, and only pairs of labels leave it.
    """
    groups = written_once(groups, "groups")
    sizes = written_once(
        groups.groupBy("group").agg(_tiles_for("few").alias("rows"), _tiles_for("member").alias("columns")).where("rows > 0"), "sizes")
    sized = groups.join(sizes, "group")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sized.where("few").withColumn("i", place("rows")).withColumn("j", every("columns")).withColumn("side", F.lit(0))
    right = sized.where("member").withColumn("j", place("columns")).withColumn("i", every("rows")).withColumn("side", F.lit(1))
    columns = ["group", "i", "j", "side", "node", "label"]
    tiles = left.select(columns).unionByName(right.select(columns)).join(sets.select("node", "items"), "node")
    tile = ["group", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*waiting, batch]).combine_chunks()
            key = np.stack([rows.column(c).to_numpy() for c in tile])
            begin = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))) if rows.num_rows else []
            for a, b in zip(begin[:-1], begin[1:]):
                yield _links_of(rows.slice(a, b - a), percent)
            waiting = rows.slice(begin[-1]).to_batches() if len(begin) else []
        if waiting:
            yield _links_of(pa.Table.from_batches(waiting), percent)

    return (
        tiles.repartition(*tile).sortWithinPartitions(*tile)
        .mapInArrow(compare, "u bigint, v bigint").distinct())


def _tiles_for(flag: str) -> Column:
    """Tiles that the flagged rows of a group need on one side."""
    return F.ceil(F.sum(F.col(flag).cast("int")) / TILE).cast("int")


def _links_of(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Pairs of labels with a linked pair of sets in a tile."""
    side, label, node = (rows.column(c).to_numpy() for c in ("side", "label", "node"))
    items = rows.column("items").combine_chunks()
    flat, size = items.flatten().to_numpy(), np.diff(items.offsets.to_numpy())
    known, code = np.unique(flat, return_inverse=True)
    end = np.cumsum(size)
    right = np.flatnonzero(side == 1)
    if not len(right):
        return pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["u", "v"])
    of_right = np.repeat(side == 1, size)
    codes, starts = code[of_right], np.concatenate(([0], np.cumsum(size[right])[:-1]))
    found = set()
    for a in np.flatnonzero(side == 0):
        has = np.zeros(len(known), np.int32)
        has[code[end[a] - size[a]:end[a]]] = 1
        same = np.add.reduceat(has[codes], starts)
        linked = (100 * same >= percent * (size[a] + size[right] - same)) & (label[right] != label[a]) & (node[right] != node[a])
        found.update((int(label[a]), int(x)) for x in label[right][linked])
    pairs = sorted(found)
    return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def _may_link(percent: int) -> Column:
    """Whether the common shingles of two nodes leave room for a link: exact, as no pair shares more."""
    most = F.least("common", "common2")
    return 100 * most >= percent * (F.col("n") + F.col("n2") - most)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("same", F.size(F.array_intersect("x", "y")))
    return (
        both.where(100 * F.col("same") >= percent * (F.size("x") + F.size("y") - F.col("same")))
        .select(F.col("a").alias("u"), F.col("b").alias("v")))
