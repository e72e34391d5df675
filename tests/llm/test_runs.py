"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import pytest
from brute import words

from gradebook.llm.periodic_runs import periodic_runs, runs_of
from gradebook.llm.queries import with_periodic_tails


def runs_brute(w, least, repeats):
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s = i - q
            if j - s >= max(least, repeats * q) and not any(all(w[x] == w[x - d] for x in range(s + d, j)) for d in range(1, q)):
                out.append((s, j - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_core_like_all_periods():
    r = random.Random(1)
    for _ in range(400):
        n, k = r.randint(0, 60), r.choice([1, 2, 2, 3])
        w = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.6:
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least, repeats in ((24, 3), (6, 3), (2, 2), (4, 2)):
            assert sorted(runs_of(w, least, repeats), key=lambda x: (x[0], x[2])) == runs_brute(w, least, repeats)


def texts():
    r, out = random.Random(2), [(None, "a " * 30), (1, None), (2, ""), (3, " \t\n"), (4, "x"), (4, "Ab " * 24), (5, "ab AB " * 30), (6, "ü　ß " * 9)]
    for i in range(150):
        parts = []
        for _ in range(r.randint(1, 6)):
            block = [r.choice("abcde") * r.randint(1, 3) for _ in range(r.randint(1, 40))]
            parts += block * r.choice([1, 1, 2, 3, 4, 9])
        out.append((100 + i, r.choice([" ", "\n", " \x0b\t "]).join(parts) + r.choice(["", " "])))
    return out


@pytest.mark.parametrize("least,repeats", [(24, 3), (10, 2), (1, 2)])
def test_texts_like_all_periods(spark, make, least, repeats):
    rows = texts()
    got = periodic_runs(make(rows), min_length=least, min_repeats=repeats)
    assert got.columns == ["doc_id", "n_words", "runs", "best", "collapsed"]
    expected = []
    for i, text in rows:
        w = words(text)
        runs = runs_brute(w, least, repeats)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        expected.append((i, len(w), runs, best, collapsed(w, runs)))
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], tuple(r.best) if r.best else None, r.collapsed) for r in got.collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_long_texts(spark, make):
    """A megabyte of one word, of one period, and a single word of a megabyte."""
    period = " ".join(f"w{i}" for i in range(20000))
    rows = [(1, "a " * 500000), (2, f"start {period} {period} {period} {period} end"), (3, "y" * 1000000)]
    got = {r.doc_id: ([tuple(x) for x in r.runs], hashlib.sha256(r.collapsed.encode()).hexdigest()) for r in periodic_runs(make(rows)).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got == {1: ([(0, 500000, 1)], sha("a")), 2: ([(1, 80000, 20000)], sha(f"start {period} end")), 3: ([], sha("y" * 1000000))}


def test_tails(spark, make):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(300)] + [(0, None), (None, "a b")]
    for i, text in map(tuple, with_periodic_tails(make(rows)).collect()):
        source = words(dict(rows)[i])
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 or not source:
            assert words(text) == source or (i == 0 and not words(text))
            continue
        g, n = h // 10, len(source)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert words(text) == [source[k if k < a else a + (k - a) % p] for k in range(n)]


def test_no_rows(spark, make):
    assert periodic_runs(make([])).count() == 0
