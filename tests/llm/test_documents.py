"""The operators on documents against plain Python, with hard cases."""

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from gradebook.llm.decontaminate import contamination, without_contaminated
from gradebook.llm.mixing import mixed, mixed_copies
from gradebook.llm.near_duplicates import Banding, near_duplicates, without_near_duplicates
from gradebook.llm.quality_rules import passing_quality, quality
from gradebook.llm.substrings import repeated_substrings

random.seed(5)
VOCABULARY = ["".join(random.choice("abcdeéßñ") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, every, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) if r.random() < 1 / every else w for w in text.split(" "))


BASE = prose(120, 1)
LONG = prose(9000, 2)
HARD = [
    (1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "Two words"), (6, "two WORDS"), (7, BASE), (8, BASE), (8, BASE), (9, BASE.upper()),
    (None, BASE + " tail"), (None, None), (10, LONG), (11, LONG[3000:30000] + " " + prose(30, 3)), (12, "ab " * 400), (13, "x" * 700),
    (14, prose(5, 4) + " " + BASE[40:400]), (15, BASE[:300] + "\n" + BASE[:300]), (16, "ÄÖ ü " * 60), (8, prose(30, 9)),
    *[(20 + i, edited(BASE, 30 + i, i)) for i in range(14)],
    *[(50 + i, prose(60, 100 + i) + "\n" + prose(40, 77) + "\n" + prose(20, 200 + i)) for i in range(6)],
]
ITEMS = [(1, BASE[100:260]), (1, prose(12, 50)), (2, "two words"), (3, None), (4, ""), (None, "one"), (5, prose(40, 77)), (6, prose(10, 77)),
         (10, LONG[5000:5100]), (7, "ab ab ab")]


def test_contamination(spark, make):
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = contamination(make(HARD), benchmark).collect()
    expected = Counter((i, *brute.contamination(t, ITEMS)[:2], tuple(brute.contamination(t, ITEMS)[2])) for i, t in HARD)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found) == expected
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in found)
    clean = without_contaminated(make(HARD), benchmark)
    assert clean.columns == make(HARD).columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((i, t) for i, t in HARD if not brute.contamination(t, ITEMS)[1])


def test_contamination_of_nothing(spark, make):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination(make([]), empty).count() == 0
    assert [(r.n_words, r.n_hit, r.contaminated) for r in contamination(make([(1, "a b")]), empty).collect()] == [(2, 0, False)]


def test_substrings(make):
    # Rows without id come last, rows that share an id are ordered by a hash of the text: none of these overlap here.
    docs = [d for d in HARD if d[0] is not None and d != (8, HARD[19][1])]
    found = repeated_substrings(make(HARD)).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    expected = brute.substrings(list(dict.fromkeys(sorted(docs, key=lambda d: d[0]))))
    got = {r[0]: tuple(r[1:]) for r in found if r[0] is not None and r[1] != len(HARD[19][1].encode())}
    assert got == expected and len(found) == len(HARD)
    # All of the row without id but for its own end was seen before.
    assert sorted((r[1], r[2]) for r in found if r[0] is None) == [(0, 0), (len((BASE + " tail").encode()), len(BASE.encode()))]


@pytest.mark.parametrize("length", [20, 64, 150])
def test_substrings_of_other_lengths(make, length):
    docs = [(i, t) for i, t in enumerate([BASE, edited(BASE, 9, 3), LONG[:2000], "ab" * 200, LONG[900:1500] + BASE, "é" * 130, "abc" * 60])]
    found = repeated_substrings(make(docs), length=length).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == brute.substrings(docs, length)


def test_substrings_of_nothing(make):
    assert repeated_substrings(make([])).count() == 0
    with pytest.raises(ValueError):
        repeated_substrings(make([]), length=500)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(make, k):
    found = near_duplicates(make(HARD), shingle=k).collect()
    expected = Counter((i, *x) for (i, _), x in zip(HARD, brute.components(HARD, k)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_one_of_each_group_stays(make):
    rows = without_near_duplicates(make(HARD))
    assert rows.columns == make(HARD).columns
    kept = [(r.doc_id, r.text) for r in rows.collect()]
    groups = brute.components(HARD, 5)
    expected = {(i, t) for (i, t), (n, least) in zip(HARD, groups) if n == 0 or i == least}
    assert set(kept) == expected and len(kept) == len(expected)


def test_a_large_group_of_near_copies(make):
    """Copies whose mutual similarity is often below the limit, in more than one tile; some are linked by nothing."""
    docs = [(i, edited(BASE, 8 + i % 60, 1000 + i)) for i in range(700)]
    found = {r.doc_id: r.component_id for r in near_duplicates(make(docs), shingle=2).collect()}
    assert found == {i: x[1] for (i, _), x in zip(docs, brute.components(docs, 2))}


def test_long_words_are_told_apart(make):
    """Two words of 1,024 letters whose sums of powers modulo 2^64 are equal."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    found = near_duplicates(make([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (2, 2), (3, 1)]


def test_rows_that_differ_elsewhere_are_kept_alike(spark, make):
    """Of rows that repeat id and text the same one stays, however the rows are dealt out."""
    rows = [(1, BASE, "en", f"s{i}", i, "w", "h", "n", "q") for i in range(40)]
    frame = spark.createDataFrame(rows, make([]).schema)
    kept = [without_near_duplicates(frame.repartition(n).orderBy(F.rand(n))).collect() for n in (1, 7)]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_texts_that_share_a_passage(make):
    """Texts of one common passage and an end of their own are below the limit and meet nobody; copies of some are found."""
    docs = [(i, BASE[:900] + " " + prose(110, 9000 + i)) for i in range(300)]
    docs += [(1000 + i, docs[i][1] + " end") for i in range(0, 300, 10)]
    found = {r.doc_id: r.component_id for r in near_duplicates(make(docs), shingle=2).collect()}
    assert found == {i: x[1] for (i, _), x in zip(docs, brute.components(docs, 2))}


def test_nothing_is_left_behind(spark, make):
    """Of the tables written on the way only two are there while the result is used."""
    from pathlib import Path

    from gradebook.sources.checkpoints import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")) / "tables"
    before = set(folder.iterdir()) if folder.exists() else set()
    assert near_duplicates(make(HARD), shingle=2).count() == len(HARD)
    assert sorted(p.name for new in set(folder.iterdir()) - before for p in new.iterdir()) == ["components", "signatures"]


def test_near_duplicates_of_nothing(make):
    assert near_duplicates(make([])).count() == 0
    assert near_duplicates(make([(1, None), (2, "")]), banding=Banding(4, 2)).where("kept").count() == 2


def test_quality(make):
    junk = [(80, " ".join(w + "***" for w in prose(90, 60).split())), (81, " | ".join(prose(90, 61).split())), (82, prose(90, 62).upper() + "!" * 90)]
    docs = HARD + [(90 + i, prose(80, 300 + i)) for i in range(20)]
    found = quality(make(docs + junk), keep=["doc_id", "text"], into="text2").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *[r.text2[n] for n in names]) for r in found) == Counter((i, *brute.base_quality(t)) for i, t in docs + junk)
    kept = {r.doc_id: r.text2.kept for r in found}
    assert all(kept[90 + i] for i in range(20)) and not kept[80]
    rows = passing_quality(make(docs + junk).withColumnRenamed("words", "_quality"))
    assert "_quality" in rows.columns and rows.count() == sum(r.text2.kept for r in found)
    assert quality(make([]), keep=["doc_id"]).count() == 0


def test_quality_of_texts_without_common_words(spark):
    """Texts with the characters of their language and none of its words, and documents labelled good."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(8)
    invented = ["".join(r.choice("aeihnorstuw") for _ in range(r.randint(4, 9))) for _ in range(90)]
    junk = spark.createDataFrame([(-1 - i, " ".join(invented), x) for i, x in enumerate(("en", "de", "fr", "es"))], docs.schema)
    found = {r.doc_id: r._quality for r in quality(docs.unionByName(junk), keep=["doc_id"]).collect()}
    assert all(found[i].class_distance < 0.3 and not found[i].base_failed and not found[i].kept for i in range(-4, 0))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1").collect()
    assert all(found[r.doc_id].kept or found[r.doc_id].base_failed for r in labels if r.doc_id in found)


def test_mixing(make):
    docs = HARD + [(1000 + i, prose(5 + i % 90, i)) for i in range(600)]
    frame = make(docs)
    found = mixed_copies(frame).collect()
    sizes = Counter()
    for k, (_, t) in enumerate(docs):
        sizes[("a", "b", None)[k % 3]] += len(brute.words(t))
    expected = brute.targets(sizes)
    assert len(found) == len(docs) and all(0 <= r.copies <= 2 and r.taken == r.copies * r["size"] for r in found)
    for source, target in expected.items():
        of = [r for r in found if r.source == source]
        assert {r.source_size for r in of} == {sizes[source]} and all(abs(r.target - target) < 1e-6 for r in of)
        assert abs(sum(r.taken for r in of) - target) <= 0.01 * target + 10
    again = mixed_copies(frame.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.row_hash, r.copies)
    assert sorted(found, key=key) == sorted(again, key=key)
    rows = mixed(frame)
    assert rows.columns == [*frame.columns, "copy"] and rows.where("copy > 2").count() == 0
    assert mixed_copies(make([])).count() == 0 and [r.copies for r in mixed_copies(make([(1, None)])).collect()] == [1]


def test_all_sources_stop_at_twice_their_size(make):
    found = mixed_copies(make([(1, "a b c")]), share=5).collect()
    assert [(r.target, r.taken) for r in found] == [(6.0, 6)]
