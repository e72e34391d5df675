"""The batch weight check against a one-by-one simulation."""

import random

from books import assessment, batch, book, rows

from gradebook.operators import quality
from gradebook.plans import maintenance

CAP = 70


def one_by_one(stored, changes):
    """Accepted seqs when changes are checked and applied in order."""
    where = {id_: (course_id, w or 0) for id_, course_id, w in stored}
    inserted, accepted = [], set()
    for c in sorted(changes, key=lambda c: c["seq"]):
        if c["id"] is not None and c["id"] not in where:
            continue
        others = sum(w for i, (course_id, w) in where.items() if course_id == c["course_id"] and i != c["id"])
        others += sum(w for course_id, w in inserted if course_id == c["course_id"])
        if others + (c["weight"] or 0) <= CAP:
            accepted.add(c["seq"])
            if c["id"] is None:
                inserted.append((c["course_id"], c["weight"] or 0))
            else:
                where[c["id"]] = (c["course_id"], c["weight"] or 0)
    return accepted


def check(spark, stored, changes):
    db = book(spark, assessments=[assessment(i, c, weight=w) for i, c, w in stored])
    frame = batch(spark, "assessments", [(c["seq"], c["id"], c["course_id"], "t", "quiz", 100, c["weight"]) for c in changes],
                  "seq id course_id title type max_mark weight")
    return db, frame, quality.check_weights(db.assessments, frame)


def insert(seq, course_id, weight, id=None):
    return {"seq": seq, "id": id, "course_id": course_id, "weight": weight}


def test_a_rejected_change_leaves_its_room_to_later_ones(spark):
    _, _, checked = check(spark, [], [insert(1, 1, 60), insert(2, 1, 20), insert(3, 1, 5)])
    assert rows(checked, "seq", "accepted", "reason") == [
        (1, True, None), (2, False, "Total assessment weight exceeds 70%."), (3, True, None)]


def test_edits_replace_their_old_weight(spark):
    stored = [(11, 1, 60), (12, 1, 10)]
    changes = [insert(1, 1, 70, id=11), insert(2, 1, 5, id=12), insert(3, 1, 5), insert(4, 1, 1)]
    _, _, checked = check(spark, stored, changes)
    assert rows(checked, "seq", "accepted") == [(1, False), (2, True), (3, True), (4, False)]


def test_unknown_ids_and_repeated_edits(spark):
    changes = [insert(1, 1, 5, id=99), insert(2, 1, -1), insert(3, 1, 9, id=11), insert(4, 1, 8, id=11), insert(5, 1, 80, id=11)]
    db, frame, checked = check(spark, [(11, 1, 10)], changes)
    assert rows(checked, "seq", "reason") == [
        (1, "Assessment not found."), (2, None), (3, None), (4, None), (5, "Total assessment weight exceeds 70%.")]
    saved, rejected = maintenance.save_assessments(db.assessments, frame, "2024-01-01 00:00:00")
    assert sorted(w for _, w in rows(saved, "id", "weight")) == [-1, 8] and rejected.count() == 2


def test_an_accepted_edit_survives_a_refused_later_one(spark):
    db, frame, checked = check(spark, [(11, 1, 10), (12, 1, 10)], [insert(1, 1, 20, id=11), insert(2, 1, 75, id=11)])
    assert rows(checked, "seq", "accepted") == [(1, True), (2, False)]
    saved, _ = maintenance.save_assessments(db.assessments, frame, "2024-01-01 00:00:00")
    assert rows(saved, "id", "weight") == [(11, 20), (12, 10)]


def test_weight_left_behind_is_free_at_once(spark):
    stored = [(11, 1, 40), (12, 1, 30), (21, 2, 10)]
    _, _, checked = check(spark, stored, [insert(1, 2, 40, id=11), insert(2, 1, 30), insert(3, 1, 15), insert(4, 2, 21), insert(5, 1, 20, id=21)])
    assert rows(checked, "seq", "accepted") == [(1, True), (2, True), (3, False), (4, False), (5, False)]


def test_negative_stored_weights_and_nulls(spark):
    stored = [(11, 1, -50), (12, 1, None)]
    changes = [insert(i, 1, 20) for i in range(1, 9)] + [insert(9, 1, None), insert(10, 1, None, id=11), insert(11, 1, 1), insert(12, 1, 0)]
    _, _, checked = check(spark, stored, changes)
    assert {r.seq for r in checked.collect() if r.accepted} == one_by_one(stored, changes)


def test_zero_weights_share_one_verdict(spark):
    stored = [(11, 1, 70), (21, 2, 71), (22, 2, 5)]
    changes = [insert(i, 1 + i % 2, 0) for i in range(10)] + [insert(20, 2, 0, id=22), insert(21, 2, 0), insert(22, 2, 0)]
    _, _, checked = check(spark, stored, changes)
    accepted = {r.seq for r in checked.collect() if r.accepted}
    assert accepted == one_by_one(stored, changes) and {0, 2, 4, 6, 8} <= accepted and 1 not in accepted


def test_same_as_one_by_one_on_many_random_courses(spark):
    random.seed(7)
    stored, changes, seq = [], [], 0
    for course_id in range(1, 121):
        ids = [course_id * 100 + i for i in range(random.randint(0, 5))]
        stored += [(i, course_id, random.choice([0, 5, 10, 15, 20])) for i in ids]
        # The larger courses get far more changes than can fit.
        for _ in range(random.choice([3, 10, 40, 150])):
            seq += 1
            target = course_id if random.random() < 0.9 else course_id % 120 + 1
            edited = random.choice(ids) if ids and random.random() < 0.3 else None
            changes.append(insert(seq, target if edited else course_id, random.choice([0, 1, 1, 2, 3, 7, 12, 30, 71, -5]), edited))
    random.shuffle(changes)
    _, _, checked = check(spark, stored, changes)
    accepted = {r.seq for r in checked.collect() if r.accepted}
    assert accepted == one_by_one(stored, changes)


def test_one_course_with_most_of_the_batch(spark):
    random.seed(3)
    stored = [(11, 1, 30), (12, 1, 20), (21, 2, 0)]
    changes = [insert(i, 1 if i % 3 else 2, random.randint(0, 40)) for i in range(1, 4001)]
    changes += [insert(5001, 1, 1, id=11), insert(2500, 1, 2, id=12)]
    changes = list({c["seq"]: c for c in changes}.values())
    _, _, checked = check(spark, stored, changes)
    assert checked.count() == len(changes)
    assert {r.seq for r in checked.collect() if r.accepted} == one_by_one(stored, changes)
