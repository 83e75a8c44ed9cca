"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

Every document is reduced once to its terms and counts, which are stored. A task then holds one block
of documents at a time as an inverted index. For each item, the short lists of its terms are
summed into accumulators; these are one more iterator, with bounds like the others, when windows of
documents are visited in order and those are skipped that cannot reach the item's 20 best.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from veduta.llm.tables import stored
from veduta.llm.wordhash import blocks, words

TOP = 20
#: Largest set of item terms (8 bytes each) that is broadcast to leave other terms out of the index; with a
#: larger one the index holds all terms.
FILTER_TERMS = 4_000_000
#: Items, and terms of items (24 bytes each), of one pass over the index.
PASS_ITEMS, PASS_TERMS = 20_000, 2_000_000
#: Postings and documents of one block, documents of one window.
BLOCK_POSTINGS, BLOCK_DOCS, WINDOW_DOCS = 1 << 20, 1 << 15, 512
#: Short lists of an item in a block hold at most this share of the block's documents, together.
SHORT_SHARE = 0.25
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


# --- terms -----------------------------------------------------------------------------------


def term_counts(texts: Sequence[str | None], known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per text the number of its terms, and hashes (sorted) and counts of those among ``known``.

    A term is a maximal run of ASCII letters and digits and of other characters than ASCII, A-Z
    lower-cased, and stands as a 64-bit hash of its bytes. Null and empty texts have none."""
    for first, end, data, starts in blocks(texts):
        value, _, _, row = words(data, starts, _SEPARATOR)
        for i in range(end - first):
            own = value[row[i] : row[i + 1]]
            n = len(own)
            if known is not None and n:
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                own = own[known[at] == own] if len(known) else own[:0]
            yield n, *np.unique(own, return_counts=True)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, times): terms of all rows of an item together; items without terms have no row."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, t, c) for i, (_, terms, counts) in zip(b["item_id"], term_counts(b["text"].tolist()), strict=True) for t, c in zip(terms.view(np.int64).tolist(), counts.tolist(), strict=True)]
            frame = pd.DataFrame(out, columns=["item_id", "term", "times"])
            yield frame.astype({"item_id": b["item_id"].dtype}) if out else frame

    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.where("text is not null").mapInPandas(count, f"item_id {kind}, term long, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def document_index(docs: DataFrame, known: np.ndarray | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts): one row for every document with a term, counted in the task that reads it."""
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(term_counts(b.column(1).to_pylist(), None if shared is None else shared.value))
            some = [i for i, r in enumerate(rows) if r[0]]
            lists = [[pa.array(rows[i][k].view(np.int64), pa.int64()) for i in some] for k in (1, 2)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists[0]])]).astype(np.int32))
            flat = [pa.ListArray.from_arrays(offsets, pa.concat_arrays(x) if x else pa.array([], pa.int64())) for x in lists]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), pa.array([rows[i][0] for i in some], pa.int64()), *flat], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(index, f"doc_id {kind}, n long, terms array<long>, counts array<long>")


# --- one block of documents ------------------------------------------------------------------


class Block:
    """Inverted index of some documents, numbered in the order in which ties are broken."""

    def __init__(self, norms: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
        """``norms``: m of each document; parallel arrays of postings: document, term, frequency."""
        order = np.lexsort((doc, term))
        self.docs, self.doc = len(norms), doc[order].astype(np.int64)
        self.quotient = (1_000_000_000 * tf[order]) // (1000 * tf[order] + 12 * norms[self.doc])
        term = term[order]
        self.terms, self.start = np.unique(term, return_index=True)
        self.start = np.append(self.start, len(term))
        # the largest quotient of every list in every window it has postings in
        self.window = self.doc // WINDOW_DOCS
        key = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(self.window, prepend=-1)) if len(term) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.quotient, key) if len(key) else np.zeros(0, np.int64)
        self.most_window = self.window[key]
        self.most_start = np.searchsorted(key, self.start)

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[int, int]]:
        """(list, weight) of the terms that occur here."""
        at = np.searchsorted(self.terms, terms)
        found = (at < len(self.terms)) & (self.terms[np.minimum(at, max(len(self.terms) - 1, 0))] == terms) if len(self.terms) else np.zeros(len(terms), bool)
        return [(int(a), int(w)) for a, w in zip(at[found], weights[found], strict=True) if w > 0]

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that may be among the item's ``top`` best; ``least`` is the score to reach.

        All documents of the block that score ``least`` or more and are not beaten by ``top`` others
        of the block are among them."""
        lists = sorted(self.lists(terms, weights), key=lambda x: self.start[x[0] + 1] - self.start[x[0]])
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        iterators, short, held = [], [], 0
        for a, w in lists:
            size = self.start[a + 1] - self.start[a]
            if held + size <= max(top, SHORT_SHARE * self.docs):
                short.append((a, w))
                held += size
            else:
                own, bound = slice(self.start[a], self.start[a + 1]), slice(self.most_start[a], self.most_start[a + 1])
                iterators.append((self.doc[own], self.quotient[own] * w, self.most_window[bound], self.most[bound] * w))
        if short:  # term at a time: the accumulators of all short lists
            doc = np.concatenate([self.doc[self.start[a] : self.start[a + 1]] for a, _ in short])
            part = np.concatenate([self.quotient[self.start[a] : self.start[a + 1]] * w for a, w in short])
            order = np.argsort(doc, kind="stable")
            doc, first = np.unique(doc[order], return_index=True)
            part = np.add.reduceat(part[order], first)
            window, first = np.unique(doc // WINDOW_DOCS, return_index=True)
            iterators.append((doc, part, window, np.maximum.reduceat(part, first)))
            if len(part) >= top:  # partial sums bound the best scores from below
                least = max(least, int(np.partition(part, len(part) - top)[len(part) - top]))
        return self._by_document(iterators, max(least, 1), top)

    def _by_document(self, iterators: list, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Document at a time over windows: skips windows, then lists, that cannot reach ``least``."""
        bounds = np.zeros((len(iterators), -(-self.docs // WINDOW_DOCS)), np.int64)
        for k, (_, _, window, most) in enumerate(iterators):
            bounds[k, window] = most
        reach = bounds.sum(axis=0)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for w in np.flatnonzero(reach >= least):
            if reach[w] < least:  # least has grown
                continue
            base = w * WINDOW_DOCS
            ascending = np.argsort(bounds[:, w], kind="stable")
            below = np.cumsum(bounds[ascending, w])
            optional = int(np.searchsorted(below, least))  # the lists before cannot reach it together
            score = np.zeros(min(WINDOW_DOCS, self.docs - base), np.int64)
            for k in ascending[optional:]:
                doc, part, _, _ = iterators[k]
                a, b = np.searchsorted(doc, (base, base + WINDOW_DOCS))
                score[doc[a:b] - base] += part[a:b]
            alive = np.flatnonzero(score)
            for place in range(optional - 1, -1, -1):
                alive = alive[score[alive] + below[place] >= least]
                if not len(alive):
                    break
                doc, part, _, _ = iterators[ascending[place]]
                at = np.minimum(np.searchsorted(doc, alive + base), len(doc) - 1)
                hit = doc[at] == alive + base
                score[alive[hit]] += part[at[hit]]
            alive = alive[score[alive] >= least]
            if len(alive):
                docs, scores = best(np.append(docs, alive + base), np.append(scores, score[alive]), top)
                if len(docs) == top:
                    least = max(least, int(scores[-1]))
        return docs, scores


def best(docs: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` highest scores, equal ones by document."""
    order = np.lexsort((docs, -scores))[:top]
    return docs[order], scores[order]


# --- the search ------------------------------------------------------------------------------


@dataclass
class Pass:
    """Items of one pass: ids, and for item i its terms and weights from ``start[i]`` to ``start[i + 1]``."""

    ids: list
    start: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def _pass(rows: list) -> Pass:
    rows.sort(key=lambda r: (False, 0, r["term"]) if r["item_id"] is None else (True, r["item_id"], r["term"]))
    ids, start = [], []
    for i, r in enumerate(rows):
        if not ids or ids[-1] != r["item_id"]:
            ids.append(r["item_id"])
            start.append(i)
    return Pass(ids, np.array([*start, len(rows)], np.int64), np.array([r["term"] for r in rows], np.int64), np.array([r["weight"] for r in rows], np.int64))


def search_blocks(index: DataFrame, items: Broadcast, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of every task for every item of the pass.

    A task carries the ``top`` best of each item from block to block, so later blocks skip more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Pass = items.value
        known = np.unique(p.terms)
        kept: dict[int, tuple[list, np.ndarray]] = {}

        def search(ids: pa.Array, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
            order = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            block = Block((100 - 25 + (25 * n * n_docs) // n_terms)[order], number[doc], term, tf)
            for i in range(len(p.ids)):
                old_ids, old = kept.get(i, ([], np.zeros(0, np.int64)))
                own = slice(p.start[i], p.start[i + 1])
                docs, scores = block.search(p.terms[own], p.weights[own], int(old[-1]) if len(old) == top else 1, top)
                if len(docs):
                    names = old_ids + ids.take(pa.array(order[docs])).to_pylist()
                    total = np.append(old, scores)
                    rank = sorted(range(len(names)), key=lambda k: (-total[k], True, 0) if names[k] is None else (-total[k], False, names[k]))[:top]
                    kept[i] = [names[k] for k in rank], total[rank]

        pending: list[tuple] = []
        docs = postings = 0
        for b in batches:
            lengths = np.diff(b.column(2).offsets.to_numpy())
            doc = np.repeat(np.arange(docs, docs + b.num_rows), lengths)
            term, tf = (b.column(k).flatten().to_numpy() for k in (2, 3))
            mine = known[np.minimum(np.searchsorted(known, term), len(known) - 1)] == term
            pending.append((b.column(0), b.column(1).to_numpy(), doc[mine], term[mine], tf[mine]))
            docs, postings = docs + b.num_rows, postings + int(mine.sum())
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                search(pa.concat_arrays([x[0] for x in pending]), *(np.concatenate([x[k] for x in pending]) for k in range(1, 5)))
                pending, docs, postings = [], 0, 0
        if docs:
            search(pa.concat_arrays([x[0] for x in pending]), *(np.concatenate([x[k] for x in pending]) for k in range(1, 5)))
        for i, (names, scores) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(names), pa.int64()), pa.array(names, kind), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    kind = to_arrow_type(index.schema["doc_id"].dataType)
    name = index.schema["doc_id"].dataType.simpleString()
    return index.mapInArrow(run, f"item long, doc_id {name}, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """Numbers the ``top`` best rows of every item; first within 64 parts of what the tasks found."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    parts = Window.partitionBy("item", "_part").orderBy(*order)
    some = found.withColumn("_part", F.spark_partition_id() % 64).withColumn("_no", F.row_number().over(parts)).where(F.col("_no") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of every item, all integers.

    Texts are read once. Equal scores rank by ascending doc_id, rows without one last; every row
    of ``docs`` is a document of its own, all rows of one item_id (null is one) are one item. Null and
    empty texts have no terms, so they never occur; without documents or items there are no rows.
    Items come to the driver in passes bounded by ``PASS_ITEMS`` and ``PASS_TERMS``; each pass reads
    the stored index, and what a task yields is bounded by ``top`` rows an item."""
    spark = docs.sparkSession
    wanted = stored(item_terms(items))
    vocabulary = wanted.select("term").distinct()
    known = None
    if vocabulary.count() <= FILTER_TERMS:
        known = np.sort(np.array([r["term"] for r in vocabulary.toLocalIterator()], np.int64).view(np.uint64))
    index = stored(document_index(docs, known, doc_id, text))
    totals = index.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    frequency = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = totals["docs"]
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long") * F.col("times")
    weighted = stored(wanted.join(frequency, "term").select("item_id", "term", weight.alias("weight")))
    size = weighted.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).first()
    passes = -(-max(size[0] * PASS_ITEMS, size[1] * PASS_TERMS) * 5 // (4 * PASS_ITEMS * PASS_TERMS))
    parts = []
    for k in range(passes if n else 0):
        rows = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()
        if not rows:
            continue
        p = _pass(rows)
        names = spark.createDataFrame([(i, name) for i, name in enumerate(p.ids)], f"item long, item_id {weighted.schema['item_id'].dataType.simpleString()}")
        found = search_blocks(index, spark.sparkContext.broadcast(p), n, totals["terms"], top)
        parts.append(ranked(found, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        ids = {f: frame.schema[f].dataType.simpleString() for f, frame in (("item_id", weighted), ("doc_id", index))}
        return spark.createDataFrame([], f"item_id {ids['item_id']}, rank int, doc_id {ids['doc_id']}, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
