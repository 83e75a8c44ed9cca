"""Near-dedup and decontamination against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tests.llm.data import edge_docs, edge_rows, no_docs, row, words
from veduta.llm import decontamination, near_dedup
from veduta.llm.components import components
from veduta.llm.decontamination import contaminated, decontaminated
from veduta.llm.near_dedup import near_duplicates, without_near_duplicates


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Expected (doc_id, n_shingles, component_id, kept) of rows, by all pairs."""
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(((i, len(s), find(i), find(i) == i) if i is not None else (None, len(s), None, True) for i, s in sets), key=str)


def family_rows():
    """Chains, near and exact copies of every degree, short texts and a shared passage."""
    r = random.Random(4)
    rows, passage = [], words(40, 9)
    for f in range(8):
        base = words(80, 100 + f)
        for c in range(9):
            text = list(base)
            for _ in range(c):
                text[r.randrange(80)] = "x%d" % r.randrange(10**6)
            rows.append(row(1000 * f + c, " ".join(text if c % 2 else [w.capitalize() for w in text])))
    rows += [row(9000 + i, " ".join(words(30, 500 + i) + passage)) for i in range(25)]
    chain = words(120, 77)
    rows += [row(9500 - i, " ".join(chain[2 * i : 2 * i + 60])) for i in range(20)]
    return rows


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 2])
def test_components_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = edge_rows() + family_rows()
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, edge_docs(spark).schema)).collect()), key=str)
    assert got == brute(rows)


def test_kept_documents(spark):
    docs = edge_docs(spark)
    out = without_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    # The row without id whose text is that of 1 goes, the one without text stays.
    assert sorted(str(k) for k in kept) == sorted(str(r[0]) for r in edge_rows() if r[0] not in (7, 8, 11) and (r[0] is not None or r[1] is None))
    assert near_duplicates(no_docs(spark)).count() == 0


def test_one_row_of_a_repeated_id_stays(spark):
    a, b = " ".join(words(30, 1)), " ".join(words(31, 2))
    rows = [row(1, a), row(1, a), row(2, b), row(2, a), row(None, a), row(None, a), row(4, None), row(4, None)]
    kept = without_near_duplicates(spark.createDataFrame(rows, edge_docs(spark).schema)).collect()
    # 2 has a text of 1, so both are one component, and so are the rows without id.
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted([("1", a), ("4", "")])


def test_rows_without_id_are_deduplicated(spark):
    a, b = " ".join(words(60, 1)), " ".join(words(61, 2))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [row(None, a), row(None, near), row(None, a.upper()), row(5, b), row(None, b), row(None, None), row(None, "")]
    kept = without_near_duplicates(spark.createDataFrame(rows, edge_docs(spark).schema).repartition(3)).collect()
    assert sum(r["text"] in (a, near, a.upper()) for r in kept) == 1
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept if r["text"] not in (a, near, a.upper())) == [(0, 0), (0, 0), (5, len(b))]


def test_repeated_id_ties_its_texts(spark):
    a, b = " ".join(words(30, 1)), " ".join(words(30, 2))
    rows = [row(1, a), row(2, b), row(3, a), row(3, b)]
    out = near_duplicates(spark.createDataFrame(rows, edge_docs(spark).schema)).collect()
    assert {r["component_id"] for r in out} == {1}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(500, 540)] + [(9, 9), (None, 3)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(500, 540)} | {7: 7}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def least_distance(item, doc):
    before = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        now = [i]
        for j, v in enumerate(doc, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (w != v)))
        before = now
    return min(before)


def edited(w, edits, r):
    w = list(w)
    for _ in range(edits):
        at = r.randrange(1, len(w) - 1)
        kind = r.randrange(3)
        if kind == 0:
            w[at] = "z%d" % r.randrange(10**6)
        elif kind == 1:
            w.insert(at, "z%d" % r.randrange(10**6))
        else:
            del w[at]
    return w


def test_leaks_by_brute_force(spark):
    r = random.Random(3)
    items = {i: words(r.randint(14, 60), 700 + i) for i in range(12)} | {50: ["only", "four", "words", "here"], 51: []}
    rows = list(edge_rows())
    for i in range(120):
        text = words(200, 2000 + i)
        if i % 2:
            item = items[i % 12]
            at = r.randrange(200)
            text[at:at] = edited(item, r.randrange(0, len(item) // 3), r)
        if i % 30 == 0:
            text[5:5] = items[50]
        rows.append(row(3000 + i, " ".join(text) if i % 3 else ", ".join(text).upper() + "!"))
    docs = spark.createDataFrame(rows, edge_docs(spark).schema)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(99, None)], "item_id long, text string")
    want = {}
    for row_ in rows:
        doc = tokens(row_[1])
        for i, w in items.items():
            if w and len(doc) < 1000 and (d := least_distance(w, doc)) <= decontamination.allowed_edits(len(w)):
                want[row_[0], i] = d
    found = contaminated(docs, bench).collect()
    got = {(x["doc_id"], x["item_id"]): x["edit_distance"] for x in found}
    assert len(found) == len(got) and set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.97 * len(want) and len(want) > 30
    sliced = {(x["doc_id"], x["item_id"]) for x in contaminated(docs, bench, at_once=4).collect()}
    assert len(sliced & set(want)) >= 0.97 * len(want) and sliced <= set(want)
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns
    hit = {d for d, _ in got}
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(str(x[0]) for x in rows if x[0] not in hit)
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert contaminated(no_docs(spark), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_short_items_by_brute_force():
    r = random.Random(6)
    vocabulary = words(30, 1)
    items = [[r.choice(vocabulary) for _ in range(n)] for n in range(1, 14) for _ in range(6)]
    index = decontamination.ItemIndex(list(range(len(items))), [next(decontamination.word_hashes([" ".join(w)]))[2] for w in items]).build(0.99)
    docs = [[], ["end"]]
    for k in range(400):
        item, doc = items[k % len(items)], words(r.randrange(12), 90 + k) + [r.choice(vocabulary) for _ in range(r.randrange(5))]
        copy = edited(item, r.randrange(len(item) // 4 + 1), r) if len(item) > 3 else item
        at = r.choice([0, len(doc), r.randrange(len(doc) + 1)])
        docs.append(doc[:at] + copy + doc[at:])
    want = {(d, i): e for d, doc in enumerate(docs) for i, w in enumerate(items) if len(w) < decontamination.SHORT and (e := least_distance(w, doc)) <= len(w) // 4}
    got = {(d, i): e for d, i, e, _ in index.matches([" ".join(d) for d in docs]) if len(items[i]) < decontamination.SHORT}
    assert got == want and len({i for (_, i), e in want.items() if e}) > 40


def test_every_length_reaches_the_recall(monkeypatch):
    r = np.random.default_rng(2)
    lengths = (12, 50, 200, 800)
    items = [r.integers(1, 1 << 62, n).astype(np.uint64) for n in lengths]
    index = decontamination.ItemIndex(list(range(4)), items).build(0.99)
    for n, item in zip(lengths, items, strict=True):
        edited_windows = []
        for _ in range(200):
            w = list(item)
            for _ in range(decontamination.allowed_edits(n)):
                kind, at, fresh = r.integers(3), r.integers(len(w)), np.uint64(r.integers(1, 1 << 62))
                w[at : at + (kind != 1)] = [] if kind == 2 else [fresh]
            edited_windows.append((w + [np.uint64(r.integers(1, 1 << 62)) for _ in range(n)])[:n])
        hit = index.looked_up(n, np.array(edited_windows, np.uint64))[0]
        assert len(set(hit.tolist())) >= 198, n
    monkeypatch.setattr(decontamination, "MOST_EMBEDDINGS", 1)
    with pytest.raises(ValueError, match="800 words"):
        decontamination.ItemIndex([3], items[3:]).build(0.99)


def test_rows_are_judged_singly(spark):
    item, clean = words(20, 5), words(40, 6)
    rows = [row(None, " ".join(clean)), row(None, " ".join([*clean, *item])), row(1, " ".join(item)), row(1, " ".join(clean)), row(2, None)]
    docs = spark.createDataFrame(rows, edge_docs(spark).schema)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(words(400, 7)))], "item_id long, text string")
    for at_once in (100, 1):
        kept = decontaminated(docs, bench, at_once=at_once)
        assert sorted((str(x["doc_id"]), x["text"] or "") for x in kept.collect()) == sorted([("None", " ".join(clean)), ("1", " ".join(clean)), ("2", "")])


def test_walks_of_equal_windows_agree():
    w = np.random.default_rng(1).integers(1, 1 << 60, (4, 30), dtype=np.uint64)
    one, two = (decontamination.embedding_keys(w, range(k, k + 3)) for k in (0, 0))
    assert (one == two).all() and one.shape == (4, 3 * decontamination.TABLES)
    assert (decontamination.embedding_keys(w, range(1, 2)) == one[:, decontamination.TABLES : 2 * decontamination.TABLES]).all()


def test_pruning_keeps_what_reaches_the_threshold():
    least = near_dedup.least_matches()
    assert len(least) == near_dedup.HASHES // near_dedup.BATCH and list(least) == sorted(least)
    assert all(m < 0.75 * near_dedup.BATCH * (k + 1) for k, m in enumerate(least))
