from __future__ import annotations

import random

import pytest

from veduta.operators import needles
from veduta.operators.needles import LANE, Automaton, first_needles, needle_hits


@pytest.mark.parametrize("seed", range(6))
def test_automaton_finds_all_substrings(seed):
    r = random.Random(seed)
    word = lambda a, b: "".join(r.choice("abé ") for _ in range(r.randint(a, b)))
    words = sorted({word(1, 7) for _ in range(60)})
    texts = [word(0, 40) for _ in range(50)] + [None, word(3 * LANE, 3 * LANE), "x" * (LANE - 2) + words[5] + "x"]
    machine = Automaton.of([w.encode() for w in words], list(range(len(words))))
    got = set(zip(*(a.tolist() for a in machine.hits([None if t is None else t.encode() for t in texts])), strict=True))
    assert got == {(i, k) for i, t in enumerate(texts) if t for k, w in enumerate(words) if w in t}


def test_needles_over_the_seam_of_two_lanes():
    machine = Automaton.of([b"needle"], [4])
    for at in range(LANE - 8, LANE + 3):
        assert machine.hits([b"." * at + b"needle" + b"." * 9])[0].tolist() == [0]
    assert Automaton.of([], []).hits([b"text"])[0].tolist() == []


def test_parts_of_needles_change_nothing(spark, monkeypatch):
    rows = [(1, "red rod and blue"), (2, "RED"), (3, None), (4, ""), (1, "small")]
    texts = spark.createDataFrame(rows, "k int, t string").repartition(3)
    rules = spark.createDataFrame([(3, "red"), (1, "blue"), (2, "rod"), (9, "red"), (2, "small"), (5, None), (5, "")], "r long, n string")
    want = sorted([(1, 1, "blue", 4), (2, None, None, 0), (3, None, None, 0), (4, None, None, 0)])
    for size in (1 << 18, 4):
        monkeypatch.setattr(needles, "PART_BYTES", size)
        assert sorted(tuple(x) for x in first_needles(texts, "k", "t", rules, "n", "r").collect()) == want
    assert needle_hits(texts, "k", "t", rules.limit(0), "n", "r").count() == 0


def test_more_needles_take_no_more_passes(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abcdé ") for _ in range(r.choice((8, 8, 8, 9, 17)))) for _ in range(60_000)})
    assert sum(len(w.encode()) for w in words) > 2 << 18
    texts = [(i, "".join(r.choice("abcdé ") for _ in range(3000))) for i in range(12)] + [(12, words[0][:-1]), (12, words[7]), (13, None), (None, words[7])]
    rules = spark.createDataFrame([(len(w) * 7919 % 13, w) for w in words], "r long, n string")
    out = first_needles(spark.createDataFrame(texts, "k int, t string").repartition(3), "k", "t", rules, "n", "r")
    want = {None: (None, None, 0)}
    for k in range(14):
        held = sorted((len(w) * 7919 % 13, w.encode()) for w in words if any(w in t for i, t in texts if i == k and t))
        want[k] = (*(held[0][0], held[0][1].decode()), len(held)) if held else (None, None, 0)
    assert {x["k"]: (x["rank"], x["needle"], x["needles"]) for x in out.collect()} == want
    passes = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert passes(first_needles(spark.createDataFrame(texts[:12], "k int, t string"), "k", "t", rules, "n", "r")) == 1


def test_needles_of_one_hash_are_told_apart(monkeypatch):
    """With a first multiplier of 1 << 63 the hash keeps one bit; finds are compared in bytes and needles told apart."""
    monkeypatch.setattr(needles, "_ODD", 1 << 63)
    words = [b"abcdefgh", b"cbcdefgh", b"ebcdefghij", b"gbcdefghij", b"a", b"c"]
    text_at, needle_at = Automaton.of(words, list(range(6))).hits([b"xcbcdefghx gbcdefghij", None, b"abcdefg", b"\0abcdefgh\0"])
    assert list(zip(text_at.tolist(), needle_at.tolist(), strict=True)) == [(0, 1), (0, 3), (0, 5), (2, 4), (2, 5), (3, 0), (3, 4), (3, 5)]
