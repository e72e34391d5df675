"""Vector operators against plain numpy on tables with copies, ties, nulls and rows without a usable vector."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradebook.llm import near_vectors as near
from gradebook.llm.hard_negatives import hard_negatives
from gradebook.llm.near_vectors import near_vectors, without_near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, n string, q string, ball string, block string"
NAN, INF = float("nan"), float("inf")
ODD = [
    (None, [1.0, 2.0], 1), (901, None, 1), (902, [1.0, None], 1), (903, [NAN, 1.0], 1), (904, [INF, 1.0], 1), (905, [1.0, 2.0], None),
    (906, [], 1), (907, [0.0, 0.0], 1), (908, [1.0, 2.0, 3.0], 1), (909, [1.0, 2.0], 1), (909, [1.0, 2.0], 1), (909, [2.0, -1.0], 2)]


@pytest.fixture(scope="module")
def table(spark):
    def frame(rows):
        return spark.createDataFrame([(i, v, lab, "x", "x", "x", "x", "x") for i, v, lab in rows], SCHEMA)

    return frame


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def linked_brute(rows, cosine=0.98):
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    v = [np.array(r[1], np.float32).astype(float) if usable(r[1]) and any(r[1]) and r[2] is not None else None for r in rows]
    for i in range(n):
        for j in range(i):
            if v[i] is not None and v[j] is not None and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]):
                if v[i] @ v[j] / (np.sqrt(v[i] @ v[i]) * np.sqrt(v[j] @ v[j])) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(n):
        ids[find(i)].append(rows[i][0])
    least = {k: min((x for x in known if x is not None), default=None) for k, known in ids.items()}
    return sorted([(rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n)], key=str)


def clusters(random, sizes, dim=16, spread=0.01):
    rows, i = [], 0
    for k, (size, wide) in enumerate(sizes):
        centre = random.standard_normal(dim)
        for _ in range(size):
            x = centre + random.standard_normal(dim) * spread * wide
            rows.append((i, (x * random.uniform(0.5, 2)).astype(np.float32).tolist(), k % 3))
            i += 1
    return rows


def test_links_like_all_pairs(table):
    random = np.random.default_rng(5)
    rows = clusters(random, [(40, 1), (30, 8), (30, 14), (25, 20), *[(1, 1)] * 60, (3, 12)]) + ODD
    rows += [(2000 + i, rows[3][1], rows[3][2]) for i in range(20)] + [(None, rows[3][1], rows[3][2])]
    got = near_vectors(table(rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == linked_brute(rows)


@pytest.mark.parametrize("tile", [3, 64])
def test_links_in_small_tiles(table, tile, monkeypatch):
    """Clusters wider than a ball are compared in many tiles; each pair counts once."""
    monkeypatch.setattr(near, "TILE", tile)
    random = np.random.default_rng(6)
    rows = clusters(random, [(60, 10), (50, 13), (40, 16)], dim=64)
    assert sorted(map(tuple, near_vectors(table(rows)).collect()), key=str) == linked_brute(rows)


def test_recall_at_the_limit(table):
    """Pairs of cosine 0.98 to 0.981 in 64 dimensions: all but a few in a thousand are found."""
    random, rows = np.random.default_rng(7), []
    for i in range(2000):
        x, y = random.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        c = random.uniform(0.98001, 0.981)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), 0)]
    assert near_vectors(table(rows)).where("n_links = 1").count() >= 2 * 1990


def test_exact_limit_links(table):
    """49 / 50 is the limit itself; a hair below is no link."""
    rows = [(1, [2.0, 0.0, 0.0, 0.0], 0), (2, [49.0, 7.0, 7.0, 1.0], 0), (3, [49.0, 7.0, 7.0, 1.001], 0)]
    got = {r.vec_id: r.n_links for r in near_vectors(table(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_one_tight_group_is_one_ball(spark, table):
    """A third of all rows in one tight group: nothing of it goes through the tiles."""
    random = np.random.default_rng(8)
    rows = clusters(random, [(700, 0.2), *[(1, 1)] * 1400], dim=64)
    frame = table(rows)
    assert frame.count() == 2100
    plain = frame.select(F.col("vec_id").alias("node"), "label", F.lit(1).cast("bigint").alias("n"), F.col("embedding").cast("array<double>").alias("vec"))
    keyed = near._keyed(plain, near.Hashing()).cache()
    members = near._members(keyed).cache()
    balls = near._balls(keyed, members, 0.98).cache()
    assert balls.groupBy("ball").count().agg(F.max("count")).first()[0] == 700
    assert near._compared(keyed, members, balls, 0.98).count() == 0
    got = near_vectors(frame)
    assert got.where("n_links = 699 AND component_id = 0").count() == 700
    assert got.where("kept").count() == 1401


def test_no_vectors(table):
    assert near_vectors(table([])).count() == 0
    assert [tuple(r) for r in near_vectors(table([(3, None, None)])).collect()] == [(3, 0, 3, True)]


def test_rows_without_near_vectors(table):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, -1.0], 0), (4, None, 0)]
    kept = without_near_vectors(table(rows))
    assert kept.columns[:3] == ["vec_id", "embedding", "label"]
    assert sorted(r.vec_id for r in kept.collect()) == [1, 2, 2, 3, 4]


def negatives_brute(rows, is_anchor, scale=256):
    known = sorted({(i, lab, tuple(int(np.floor(float(np.float32(x)) * scale)) for x in v)) for i, v, lab in rows if i is not None and lab is not None and usable(v)})
    out = []
    for a in known:
        if not is_anchor(a[0]):
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))
        ranked = sorted(((-score(r), r[0], r[1]) for r in known), key=lambda r: r[:2])
        for s, positive, _ in [r for r in ranked if r[1] != a[0] and r[2] == a[1]][:5]:
            band = [(-n, i) for n, i, lab in ranked if lab != a[1] and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(a[0], positive, k + 1, i, -s, n) for k, (n, i) in enumerate(band[:10])]
    return sorted(out)


@pytest.mark.parametrize("dim,grid", [(64, 1.0), (13, 4.0), (3, 2.0)])
def test_negatives_like_brute_force(table, dim, grid, monkeypatch):
    """Coarse grids make ties; small blocks make several of both kinds."""
    import gradebook.llm.hard_negatives as module

    monkeypatch.setattr(module, "ANCHORS", 4)
    random = np.random.default_rng(dim)
    rows = [(i, (np.round(random.standard_normal(dim) * grid) / grid / (8 if dim == 64 else 1)).tolist(), int(random.integers(0, 4))) for i in range(400)]
    rows += [(10 * i, rows[10 * i][1], rows[10 * i][2]) for i in range(5)] + ODD
    got = hard_negatives(table(rows), F.col("vec_id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == negatives_brute(rows, lambda i: i % 20 == 0)


def test_large_components_are_exact(table):
    random = np.random.default_rng(3)
    rows = [(i, (random.standard_normal(9) * 3000).tolist(), i % 2) for i in range(120)]
    got = hard_negatives(table(rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_brute(rows, lambda i: i % 10 == 0)


def test_too_large_components_end_the_job(table):
    with pytest.raises(ValueError, match="too large"):
        hard_negatives(table([(0, [1e30], 1), (1, [1.0], 1)]), F.col("vec_id") == 0)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(0, [], 1)], [(0, None, 1), (2, [1.0], 1)], [(0, [1.0], 1)]])
def test_no_negatives(table, rows):
    assert hard_negatives(table(rows), F.col("vec_id") % 100 == 0).count() == 0
