"""Every registered query against its SQL, and the driver's entry points."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from tests.oracle import connect, same
from veduta import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(name, spark, sf_dir, con):
    same(plans.QUERIES[name](spark, sf_dir), con, plans.SQL[name])


def test_fuzzy_titles(spark, sf_dir):
    from difflib import SequenceMatcher

    names = sorted({r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").collect()})
    want = set()
    for a in names:
        near = sorted(((-r, b) for b in names if (r := SequenceMatcher(None, a, b).ratio()) >= 0.6))[:6]
        want |= {(a, b, round(-r, 9)) for r, b in near if a != b}
    got = {(r["left_name"], r["right_name"], round(r["score"], 9)) for r in plans.QUERIES["artist_options_fuzzy"](spark, sf_dir).collect()}
    assert got == want


def test_fuzzy_composers(spark, sf_dir):
    from difflib import SequenceMatcher

    from veduta.operators.matching import common_run

    assert [common_run(t) for t in (0.6, 0.86, 0.9)] == [1, 2, 3]
    letters = str.maketrans("0123456789", "aeioulnrst")
    names = sorted({f"{r[0].lower()} {str(r[1]).translate(letters)}" for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment", "c_custkey").collect()})
    want = set()
    for raw in {n[1:5] + "x" + n[6:] for n in names}:
        near = sorted((-r, n) for n in names if (r := SequenceMatcher(None, raw, n).ratio()) >= 0.86)[:5]
        want |= {(raw, n, round(-r, 9)) for r, n in near}
    got = {(r["raw"], r["composer"], round(r["score"], 9)) for r in plans.QUERIES["composer_candidates"](spark, sf_dir).collect()}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("needle", [None, "Brnad#12", "", "BUILDNIG"])
def test_keyword_search_by_brute_force(spark, sf_dir, needle):
    import re
    from difflib import SequenceMatcher

    from veduta.plans.catalogue import ARTIST, KEYWORD

    read = lambda t: [r.asDict() for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    key = lambda v: re.sub(r"\s+", " ", re.sub(r"[^\w\s'\-]", " ", v.lower())).strip()
    works = {r["p_partkey"]: [r["p_name"], r["p_brand"]] for r in read("part")}
    venues = {r["c_custkey"]: [r["c_mktsegment"], r["c_name"]] for r in read("customer")}
    artists = {r["s_suppkey"]: r["s_name"] for r in read("supplier")}
    events = {r["o_orderkey"]: r["o_custkey"] for r in read("orders")}
    word, memo = key(KEYWORD if needle is None else needle), {}

    def score(values):
        keys = [key(v) for v in values if v]
        for v in keys:
            memo.setdefault(v, SequenceMatcher(None, word, v).ratio())
        tiers = (1.0, any(v == word for v in keys)), (0.9, any(v.startswith(word) for v in keys)), (0.8, any(word in v for v in keys))
        return next((t for t, hit in tiers if hit), max((memo[v] for v in keys), default=0.0)) if word else 0.0

    want = {}
    slots = [(r["l_orderkey"], works.get(r["l_partkey"], []), artists.get(r["l_suppkey"])) for r in read("lineitem")]
    for event, work, artist in slots + [(e, [], None) for e in set(events) - {s[0] for s in slots}]:
        if event in events:
            s = score([*work, *venues.get(events[event], []), artist])
            before = want.get(event, (0.0, False))
            want[event] = max(s, before[0]), before[1] or artist == ARTIST
    want = {e: (round(s, 9), hit) for e, (s, hit) in want.items() if s >= 0.6 or hit}
    query = plans.QUERIES["keyword_search_fuzzy"]
    got = query(spark, sf_dir) if needle is None else query(spark, sf_dir, needle)
    assert {r["event_id"]: (round(r["score"], 9), r["via_artist"]) for r in got.collect()} == want
    assert needle == "" or any(s >= 0.6 and s not in (0.8, 0.9, 1.0) for s, _ in want.values())


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(plans.QUERIES) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0
