"""Spot signatures, their comparison and the order of documents against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import edge_docs, edge_rows, no_docs, row, words
from veduta.llm.fingerprints import ANCHORS, LEAST, STRETCH, decoded, encoded, fingerprint_documents, length_partition, likeness, near_classes, similar_sets, spot_signatures, with_next_text
from veduta.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_signatures(text, chain=2, distance=1):
    """The multiset of signatures by the definition."""
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out, run = Counter(), 0
    for i, w in enumerate(ws):
        run = 0 if w in ANCHORS else run + 1
        content = [x for x in ws[i + 1 :] if x not in ANCHORS][distance - 1 :: distance][:chain]
        if (w in ANCHORS or run > STRETCH) and len(content) == chain:
            out[(w, *content)] += 1
    if not out and len(ws) > chain:
        out = Counter(tuple(ws[i : i + chain + 1]) for i in range(len(ws) - chain))
    elif not out and ws:
        out = Counter([tuple(ws)])
    return out


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 1.0


def texts(n, seed, length=60):
    r = random.Random(seed)
    return [" ".join(r.choice(ANCHORS) if r.random() < 0.4 else r.choice(words(40, 9)) for _ in range(r.randint(0, length))) for _ in range(n)]


@pytest.mark.parametrize("chain,distance", [(2, 1), (3, 1), (2, 3), (1, 1)])
def test_signatures_by_definition(chain, distance):
    some = [*texts(80, 1), " ".join(words(50, 3)), " ".join([*words(20, 4), "the", *words(9, 5), "of", *words(8, 6)]), None, "", "!! ??", "The, Über-cat and THE über: cat sat", "of", "word", "two words", "three plain words", "the the the the"]
    for text, elements in zip(some, spot_signatures(some, ANCHORS, chain, distance), strict=True):
        assert len(elements) == sum(plain_signatures(text, chain, distance).values())
    a = list(spot_signatures(some, ANCHORS, chain, distance))
    for i in range(0, len(some), 3):
        for j in range(len(some)):
            assert likeness(a[i], a[j]) == pytest.approx(jaccard(plain_signatures(some[i], chain, distance), plain_signatures(some[j], chain, distance)))


def test_fingerprints_as_text():
    for elements in spot_signatures(texts(30, 2)):
        assert (decoded(encoded(elements)) == elements).all() and len(encoded(elements)) == 8 * len(elements)


def test_pruned_likeness_is_exact_above_the_bound():
    r = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(r.integers(0, 300, r.integers(1, 200)).astype(np.uint64))
        b = a[r.random(len(a)) < r.random()] if r.random() < 0.7 else np.unique(r.integers(0, 300, 80).astype(np.uint64))
        full = likeness(a, b)
        for least in (0.3, 0.75):
            assert likeness(a, b, least, piece=16) == (full if full >= least else 0.0)
        if len(b) and full >= 0.75:
            assert abs(length_partition(len(a)) - length_partition(len(b))) <= 1


def with_next(rows):
    """(doc_id, text, next text) by sorting everything; only for rows of distinct ids."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    return [(i, t, ordered[(k + 1) % len(ordered)][1]) for k, (i, t) in enumerate(ordered)]


def check(rows, got):
    got = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, text, following in with_next(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, new, nxt = (list(spot_signatures([t]))[0] for t in (text, edited, following))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (encoded(own), encoded(new))
        assert r["near_edited"] == pytest.approx(jaccard(plain_signatures(text), plain_signatures(edited))) if len(text) < 5000 else True
        assert (r["near_edited"], r["near_next"]) == (likeness(own, new), likeness(own, nxt))


def test_query_by_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = QUERIES["op12_fingerprints"](spark, sf_dir)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    check(rows, out.collect())


def test_edge_cases(spark):
    unique = {r[0]: r for r in edge_rows()}
    check([r[:2] for r in unique.values()], fingerprint_documents(spark.createDataFrame(list(unique.values()), edge_docs(spark).schema).repartition(3)).collect())
    assert fingerprint_documents(edge_docs(spark)).count() == len(edge_rows())
    assert fingerprint_documents(no_docs(spark)).count() == 0
    (one,) = fingerprint_documents(spark.createDataFrame([row(5, "the only text of all")], edge_docs(spark).schema)).collect()
    assert one["near_next"] == 1.0
    empty = fingerprint_documents(spark.createDataFrame([row(1, None), row(2, "")], edge_docs(spark).schema)).collect()
    assert [(r["fingerprint"], r["n_chars"], r["near_next"]) for r in empty] == [("", 0, 1.0)] * 2


def test_next_texts_over_many_ranges_and_repeated_ids(spark):
    rows = [(i * 7 % 1009, f"t{i * 7 % 1009}") for i in range(1009)]
    got = {(r["doc_id"], r["text"], r["next_text"]) for r in with_next_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()}
    assert got == set(with_next(rows))
    same = spark.createDataFrame([(1, f"x{i % 5}") for i in range(400)] + [(None, "n")] * 300, "doc_id long, text string")
    out = Counter((r["text"], r["next_text"]) for r in with_next_text(same).collect())
    assert sum(out.values()) == 700 and sum(n for (a, b), n in out.items() if a != b) == 6  # five texts and the nulls, each followed by itself but once


def test_classes_by_brute_force(spark):
    rows, r = [], random.Random(3)
    for base in texts(25, 4, 200):
        for _ in range(r.randint(1, 6)):
            ws = base.split()
            for _ in range(r.choice([0, 0, 1, 3, 12])):
                if ws:
                    ws[r.randrange(len(ws))] = "changed"
            rows.append((len(rows), " ".join(ws)))
    rows += [(900, None), (901, ""), (902, "!!")]
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(4)
    sets = {i: plain_signatures(t) for i, t in rows}
    component = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and jaccard(sets[i], sets[j]) >= LEAST:
                low, high = sorted((component[i], component[j]))
                component = {k: low if c == high else c for k, c in component.items()}
    got = near_classes(docs).collect()
    assert {r["doc_id"]: (r["n_signatures"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == {i: (sum(s.values()), component[i], component[i] == i) for i, s in sets.items()}
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert near_classes(docs.limit(0)).count() == 0


def test_labels_within_a_group():
    sets = [np.arange(100, dtype=np.uint64), np.arange(5, 100, dtype=np.uint64), np.arange(1000, 1010, dtype=np.uint64), np.arange(1, 101, dtype=np.uint64)]
    assert similar_sets([s.tobytes() for s in sets]).tolist() == [0, 0, 2, 0]
