"""Ranked lexical search against a scan of everything."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.data import edge_docs, edge_rows, no_docs, words
from tests.oracle import connect, same
from veduta.llm import lexical_search
from veduta.llm.lexical_search import WINDOW_DOCS, Block, item_terms, rank_documents, term_counts
from veduta.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, top=20):
    """All documents scored for all items. docs, items: (id, text)."""
    counted = [(i, Counter(t := terms(x)), len(t)) for i, x in docs if terms(x)]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(Counter)
    for i, text in items:
        asked[i].update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: s[:2] if s[1] else s)
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scored[:top])]
    return Counter(out)


def rows_of(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id long, text string, score string, rank string")


ITEMS = [(1, "one two " + " ".join(words(60, 1)[:20])), (2, None), (3, "!! -- "), (4, "UN deux un TROIS één"), (None, "big id twee"), (4, "drie"), (5, "12"), (6, "zzzzzz"), (7, " ".join(words(60_000, 2)))]


def test_edge_cases(spark):
    got = rows_of(rank_documents(edge_docs(spark), items_of(spark, ITEMS)))
    assert got == brute_force([r[:2] for r in edge_rows()], ITEMS) and got


def test_empty_tables(spark):
    for docs, items in ((no_docs(spark), ITEMS), (edge_docs(spark), []), (edge_docs(spark).where("text is null"), ITEMS)):
        out = rank_documents(docs, items_of(spark, items))
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_small_blocks_passes_and_no_filter_change_nothing(spark, sf_dir, monkeypatch):
    con = connect(sf_dir)
    monkeypatch.setattr(lexical_search, "FILTER_TERMS", 0)
    monkeypatch.setattr(lexical_search, "PASS_TERMS", 900)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 30)
    monkeypatch.setattr(lexical_search, "WINDOW_DOCS", 8)
    same(QUERIES["op11_lexical_search"](spark, sf_dir), con, ORACLES["op11_lexical_search"])


def test_ties_of_a_large_group_go_by_doc_id(spark):
    rows = [(i, "same words here") for i in range(900, 0, -1)] + [(i, "other words") for i in range(1000, 1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = [(1, "same here"), (2, "words"), (3, "other same")]
    assert rows_of(rank_documents(docs, items_of(spark, items))) == brute_force(rows, items)


@pytest.mark.parametrize("seed", range(4))
def test_a_block_skips_without_loss(seed):
    """Lists of very different lengths over many windows; the least score grows on the way."""
    rng = np.random.default_rng(seed)
    n = 6 * WINDOW_DOCS + 17
    norms = rng.integers(80, 300, n)
    doc, term = [], []
    for t in range(30):
        some = np.flatnonzero(rng.random(n) < 0.9 ** (t + 1) * rng.random())
        doc.append(some)
        term.append(np.full(len(some), t))
    doc, term = np.concatenate(doc), np.concatenate(term)
    tf = rng.integers(1, 9, len(doc))
    order = rng.permutation(len(doc))
    block = Block(norms, doc[order], term[order], tf[order])
    for _ in range(20):
        asked = np.sort(rng.choice(40, 12, replace=False))
        weights = rng.integers(0, 5000, 12)
        full = np.zeros(n, np.int64)
        for t, w in zip(asked, weights, strict=True):
            at = term == t
            full[doc[at]] += w * (1_000_000_000 * tf[at] // (1000 * tf[at] + 12 * norms[doc[at]]))
        want = sorted((-s, d) for d, s in enumerate(full) if s > 0)[:20]
        least = int(rng.choice([1, max(1, -want[10][0] if len(want) > 10 else 1)]))
        docs, scores = block.search(asked, weights, least, 20)
        assert [w for w in want if -w[0] >= least] == [(-s, d) for d, s in zip(docs.tolist(), scores.tolist(), strict=True) if s >= least]


def test_terms_of_all_kinds_of_texts(spark):
    texts = ["A-b_c,1.5", "Ünïcode 語 \x7f x\x00y", "", None, "`a`{b}[c]^@z"]
    assert [n for n, *_ in term_counts(texts)] == [len(terms(t)) for t in texts] == [5, 4, 0, 0, 4]
    got = item_terms(items_of(spark, [(1, "a A b"), (1, "a"), (2, "é É")])).collect()
    assert sorted((r["item_id"], r["times"]) for r in got) == [(1, 1), (1, 3), (2, 1), (2, 1)]
