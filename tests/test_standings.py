"""Ranks from stored blocks equal ranks computed anew, and few blocks are read."""

import random

import pytest
from books import rows

from gradebook.plans.standings import Standings, _keyed

TOTALS = "course_id BIGINT, student_id BIGINT, total_points BIGINT"


def ranked(totals):
    out = []
    for course in {c for c, _ in totals}:
        order = sorted((-p, s) for (c, s), p in totals.items() if c == course)
        out += [(course, s, k + 1) for k, (_, s) in enumerate(order)]
    return sorted(out)


@pytest.fixture
def frame(spark):
    return lambda totals: spark.createDataFrame([(c, s, p) for (c, s), p in totals.items()], TOTALS)


@pytest.mark.parametrize("block", [4, 15])
def test_ranks_after_moves(spark, frame, tmp_path, block):
    """Courses of all sizes, so that blocks hold one or several of them; ties; students that come and go."""
    r = random.Random(block)
    totals = {(c, s): r.randrange(8) * 10 for c, size in ((1, 40), (2, 1), (3, 2), (4, 25), (7, 3)) for s in range(size)}
    kept = Standings.create(frame(totals), f"{tmp_path}/standings", rows_per_file=block)
    assert rows(kept.ranks(frame(totals))) == ranked(totals)
    for _ in range(2):
        moved = dict(r.sample(sorted(totals.items()), 9))
        new = {k: r.randrange(8) * 10 for k in list(moved)[:6]} | {(r.choice([1, 2, 5, 9]), 100 + r.randrange(50)): 30 for _ in range(4)}
        new = {k: p for k, p in new.items() if k in moved or k not in totals}
        kept.move(frame(moved), frame(new))
        totals = {k: p for k, p in totals.items() if k not in moved} | new
        assert rows(kept.ranks(frame(totals))) == ranked(totals)
    some = dict(r.sample(sorted(totals.items()), 5))
    assert rows(kept.ranks(frame(some))) == [x for x in ranked(totals) if x[:2] in some]
    assert kept.ranks(frame({(1, 5000): 10, (77, 1): 10})).count() == 0


def test_a_move_touches_two_blocks(spark, frame, tmp_path):
    totals = {(1, s): 10 * s for s in range(400)}
    kept = Standings.create(frame(totals), f"{tmp_path}/standings", rows_per_file=10)
    before = {x._file for x in kept.table.manifest().collect()}
    kept.move(frame({(1, 10): 100}), frame({(1, 10): 3900}))
    after = {x._file for x in kept.table.manifest().collect()}
    assert len(before) == 40 and len(before - after) == 2 and len(after - before) == 2
    assert rows(kept.ranks(frame({(1, 10): 3900, (1, 200): 2000}))) == [(1, 10, 10), (1, 200, 201)]
    assert kept.table.files_of(_keyed(frame({(1, 200): 2000}))).count() == 1
    same = kept.table.commit().version
    assert kept.move(frame({(1, 10): 3900}), frame({(1, 10): 3900})) == same
