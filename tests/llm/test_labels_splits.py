"""Consensus and grouped splits on planted data and edge cases."""

import random
from collections import Counter

import pytest

from lexispark.llm import labels, splits

PREFS = "comparisonid string, annotatorid string, dimension string, choice string, reason string, revision int, saved_at timestamp, received_at timestamp, k int, l double, item string"
COMP = "comparisonid string, authorid string, postid string, source string, private struct<group: string, split: string>, a int, b int, e0 string, component string"


def prefs(spark, rows):
    return spark.createDataFrame([(c, a, d, ch, None, r, None, None, 1, 1.0, "x") for c, a, d, ch, r in rows], PREFS)


def test_planted_truth_beats_majority(spark):
    rng = random.Random(5)
    kinds = {f"r{i}": ("good" if i < 9 else "spam" if i < 13 else "random") for i in range(16)}
    truth = {f"c{i}": rng.choice(labels.CHOICES[:3]) for i in range(250)}
    rows = []
    for c, t in truth.items():
        for a in rng.sample(sorted(kinds), 5):
            k = kinds[a]
            ch = (t if rng.random() < 0.85 else rng.choice(labels.CHOICES)) if k == "good" else "tie" if k == "spam" else rng.choice(labels.CHOICES)
            rows.append((c, a, "S", ch, 1))
    items, people = labels.discover(prefs(spark, rows))
    got = {r.comparisonid: r.choice for r in items.collect()}
    votes = {}
    for c, _, _, ch, _ in rows:
        votes.setdefault(c, []).append(ch)
    major = {c: Counter(v).most_common(1)[0][0] for c, v in votes.items()}
    acc = lambda x: sum(x[c] == t for c, t in truth.items()) / len(truth)
    assert len(got) == 250 and acc(got) > acc(major) + 0.02 and acc(got) > 0.8
    err = {r.annotatorid: r.error for r in people.collect()}
    assert max(err[a] for a in kinds if kinds[a] == "good") < min(err[a] for a in kinds if kinds[a] != "good")


def test_answers_edges(spark):
    rows = [
        ("c", "a", "S", " Left ", 1), ("c", "a", "S", "right", 2), ("c", "a", "S", "right", 2), ("c", None, "S", "left", 9), ("c", "b", "S", None, 3), ("c", "b", "S", "LEFT", 1),
        ("c", "d", "S", "cannot_judge", 1), ("c", "e", "S", "left", None), ("c", "f", "S", " ", 1), ("c", "g", "S", "nonsense", 1), (None, "a", None, "tie", 1),
    ]
    got = sorted(map(tuple, labels.answers(prefs(spark, rows)).collect()), key=str)
    assert got == sorted([("c", "S", "a", "right"), ("c", "S", "b", "left"), ("c", "S", "d", "cannot_judge"), ("c", "S", "e", "left"), (None, None, "a", "tie")], key=str)
    items, people = labels.discover(prefs(spark, rows))
    r = items.collect()
    assert len(r) == 1 and r[0].votes == 3 and r[0].agreement == pytest.approx(1 / 3)  # one of the three pairs agrees
    items, people = labels.discover(prefs(spark, []))
    assert items.count() == 0 and people.count() == 0


def test_ties_go_to_the_first_choice(spark):
    rows = [("c", a, "S", ch, 1) for a, ch in (("a", "right"), ("b", "left"), ("d", "tie"))]
    assert labels.discover(prefs(spark, rows))[0].first().choice == "left"


def comps(spark, rows):
    return spark.createDataFrame([(c, a, p, s, None if g is None and sp is None else (g, sp), 1, 2, "x", "y") for c, a, p, s, g, sp in rows], COMP)


def test_broken_splits(spark):
    rows = [
        ("1", "Ann ", None, "s1", None, "train"), ("2", "ann", "p", "s2", "g", "train"), ("3", None, "P ", "s3", None, None), ("4", None, None, "s3", "h", "test"),
        ("5", "bob", None, "s5", None, "train"), ("6", "bob", None, "s6", None, "train"), ("7", None, None, None, None, "test"), ("7", None, None, None, None, "test"), (None, "ann", None, "z", None, "test"),
    ]
    df = comps(spark, rows)
    assert sorted(r[0] for r in splits.broken(df).collect()) == ["1", "2", "3", "4"]
    c = {r[0]: r[1] for r in splits.components(df).collect()}
    assert c["1"] == c["4"] == "1" and c["5"] == c["6"] and c["7"] == "7" and len(c) == 7
    assert splits.broken(comps(spark, [])).count() == 0


def test_assignment_keeps_groups_and_shares(spark):
    rows = [(str(i), "hot" if i < 300 else f"a{i // 2}", None, f"s{i}", None, None) for i in range(1500)]
    t = spark.createDataFrame([("train", 0.7, 1), ("validation", 0.2, 1), ("test", 0.1, 1), (None, 0.5, 1), ("none", None, 1)], "split string, target_share double, n int")
    got = splits.assign(comps(spark, rows), t).collect()
    by = {}
    for r in got:
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values()) and len(got) == 1500
    n = Counter(r.split for r in got)
    assert abs(n["train"] / 1500 - 0.7) < 0.05 and abs(n["test"] / 1500 - 0.1) < 0.04
    again = {r.comparisonid: r.split for r in splits.assign(comps(spark, rows[::-1]), t).collect()}
    assert again == {r.comparisonid: r.split for r in got}
    assert splits.assign(comps(spark, []), t).count() == 0
    with pytest.raises(ValueError):
        splits.assign(comps(spark, rows[:3]), t.limit(0))


def test_large_pools_stop_by_the_same_rule(spark, monkeypatch):
    """Choices and errors are the same on both sides of POOL_LIMIT."""
    rng = random.Random(8)
    rows = [(f"c{i}", a, "S", "left" if rng.random() < 0.75 else rng.choice(labels.CHOICES), 1) for i in range(60) for a in rng.sample([f"r{k}" for k in range(12)], 5)]

    def run():
        items, people = labels.discover(prefs(spark, rows), tol=0.05)
        return {r.comparisonid: (r.choice, round(r.support, 9)) for r in items.collect()}, {r.annotatorid: round(r.error, 9) for r in people.collect()}

    small = run()
    monkeypatch.setattr(labels, "POOL_LIMIT", 3)
    assert run() == small
    # nor does it matter whether an item's votes are summed up before they meet
    monkeypatch.setattr(labels, "CROWD", 5)
    monkeypatch.setattr(labels, "CROWDED", 10**9)
    assert run() == small


def test_plain_weights(spark):
    """Without habits the truth is the choice of least weighted distance: two strangers outvote a third, but not one whose votes
    on other items were always right.
    """
    rows = [("c", a, "S", ch, 1) for a, ch in (("a", "right"), ("b", "right"), ("d", "left"))]
    few = labels.discover(prefs(spark, rows), rounds=3, habits=False)[0].first()
    more = labels.discover(prefs(spark, rows + [(f"x{i}", "d", "S", "tie", 1) for i in range(6)]), rounds=3, habits=False)[0].first()
    assert few.choice == "right" and 0.5 < few.support <= 1 and more.choice == "left"


def test_pure_hash_ranges_move_nothing(spark):
    """Without balance a component keeps its split when unrelated records come in."""
    t = spark.createDataFrame([("train", 0.7, 1), ("validation", 0.2, 1), ("test", 0.1, 1)], "split string, target_share double, n int")
    rows = [(str(i), f"a{i // 2}", None, f"s{i}", None, None) for i in range(600)]
    more = rows + [(f"n{i}", "giant", None, f"z{i}", None, None) for i in range(600)]
    small = {r.comparisonid: r.split for r in splits.assign(comps(spark, rows), t, balance=False).collect()}
    large = {r.comparisonid: r.split for r in splits.assign(comps(spark, more), t, balance=False).collect()}
    assert all(large[c] == s for c, s in small.items())
    n = Counter(small.values())
    assert abs(n["train"] / 600 - 0.7) < 0.08
