"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veduta.llm.samples import bounded_sample, held_out
from veduta.llm.tables import without
from veduta.llm.wordhash import blocks, mix, words

#: Labelled documents per label whose vectors are broadcast (PER_LABEL x 2 x DIMENSIONS floats).
PER_LABEL, DIMENSIONS, NEIGHBOURS = 1500, 32, 15
#: Terms: hashed words, then hashed shapes of words.
WORD_TERMS, SHAPE_TERMS = 1 << 11, 1 << 10
TERMS = WORD_TERMS + SHAPE_TERMS
#: Documents whose cosines are computed at once.
ROWS_AT_ONCE = 512

_CLASS = np.zeros(256, np.uint8)  # 0 punctuation and symbols
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4


def term_counts(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """Per text the counts of its terms over the whole text.

    A word has two terms: its hash, and its shape: class of the first byte, the last two bytes where
    these are symbols, whether it is all upper case, holds a digit or is all symbols, its length
    up to 15 bytes, and whether it repeats the word before."""
    for first, end, data, starts in blocks(texts):
        value, begin, stop, row = words(data, starts)
        raw = np.frombuffer(data, np.uint8)
        kind = _CLASS[raw]
        sums = {k: np.concatenate([[0], np.cumsum(kind == k)]) for k in (0, 1, 2, 3)}
        held = {k: s[stop] - s[begin] for k, s in sums.items()}
        length = stop - begin
        last, before = raw[stop - 1], raw[np.maximum(stop - 2, begin)]
        shape = kind[begin].astype(np.uint64)
        for part in (
            np.where(kind[stop - 1] == 0, last, 0),
            np.where(_CLASS[before] == 0, before, 0),
            (held[2] > 1) & (held[1] == 0),
            held[3] > 0,
            held[0] == length,
            np.minimum(length, 15) // 3,
            np.concatenate([[False], value[1:] == value[:-1]]) if len(value) else np.zeros(0, bool),
        ):
            shape = mix(shape * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
        term = np.concatenate([(value & np.uint64(WORD_TERMS - 1)).astype(np.int64), WORD_TERMS + (shape & np.uint64(SHAPE_TERMS - 1)).astype(np.int64)])
        n = len(value)
        for i in range(end - first):
            a, b = row[i], row[i + 1]
            yield np.bincount(term[a:b], minlength=TERMS) + np.bincount(term[n + a : n + b], minlength=TERMS)


@dataclass
class QualityModel:
    """Labelled unit vectors (``neighbours`` x dimensions) and the projection that makes them."""

    projection: np.ndarray  # TERMS x DIMENSIONS, idf included
    vectors: np.ndarray
    labels: np.ndarray
    base: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts) @ self.projection)

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        out, pending = [], []
        for c in term_counts(texts):
            pending.append(c)
            if len(pending) == ROWS_AT_ONCE:
                out.append(self._vote(np.stack(pending)))
                pending = []
        if pending:
            out.append(self._vote(np.stack(pending)))
        return np.concatenate(out) if out else np.zeros(0)

    def _vote(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.base)
        cosine = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 4
        total = weight.sum(axis=1)
        share = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where((total > 0) & (counts.sum(axis=1) > 0), share, self.base), 0, 1)


def weighted(counts: np.ndarray) -> np.ndarray:
    """Term shares of a document, damped; words weigh less than shapes."""
    share = counts.astype(np.float32)
    share /= np.maximum(1, counts.sum(axis=-1, keepdims=True))
    np.sqrt(share, out=share)
    share[..., :WORD_TERMS] *= 0.25
    return share


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def labelled_counts(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """doc_id, quality, terms, counts: the non-zero term counts of the picked documents, as bytes.

    Counted in the tasks that read the texts. A doc_id that repeats teaches once, with the least
    of its rows by terms and counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            terms, numbers = [], []
            for c in term_counts([t if isinstance(t, str) else None for t in batch["text"]]):
                at = np.flatnonzero(c)
                terms.append(at.astype("<u2").tobytes())
                numbers.append(c[at].astype("<u4").tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "terms": terms, "counts": numbers})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").join(F.broadcast(picked.select("doc_id", "quality")), "doc_id")
    counted = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInPandas(count, "doc_id long, quality int, terms binary, counts binary")
    one = counted.groupBy("doc_id", "quality").agg(F.min(F.struct("terms", "counts")).alias("least"))
    return one.select("doc_id", "quality", "least.terms", "least.counts")


def leading_directions(x: np.ndarray, dimensions: int, rounds: int = 12) -> np.ndarray:
    """The leading right singular vectors of ``x`` as columns, by block power iteration.

    A few products with a thin block replace the decomposition of a square matrix. Directions
    whose singular value is next to nothing are left out."""
    thin = min(dimensions + 16, *x.shape)
    block = np.random.default_rng(17).standard_normal((x.shape[1], thin)).astype(np.float32)
    for _ in range(rounds):
        block, _ = np.linalg.qr(x.T @ (x @ block))
    _, values, turn = np.linalg.svd(x @ block, full_matrices=False)
    keep = np.flatnonzero(values[:dimensions] > 1e-4)
    return block @ turn.T[:, keep]


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> QualityModel:
    """Latent-semantic vectors of at most ``per_label`` documents of each label, from the leading
    singular vectors of their TF-IDF matrix; labels come from outside the held-out fold only, a
    document with several labels takes the largest, labels other than 0 and 1 count as none. Without
    labelled rows every score is 0.5; documents without words get the share of label 1 among all
    training labels. The driver holds one float per labelled document and term, 37 MB."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    base = known.agg(F.avg("quality")).first()[0]
    picked = bounded_sample(known, "quality", per_label)
    rows = labelled_counts(docs, picked).orderBy("doc_id").collect()
    if not rows:
        return QualityModel(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5 if base is None else base)
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["terms"], "<u2")] = np.frombuffer(r["counts"], "<u4")
    y = np.array([r["quality"] for r in rows], float)
    del rows
    idf = (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    x = weighted(x)
    x *= idf
    right = leading_directions(x, DIMENSIONS)
    return QualityModel((idf[:, None] * right).astype(np.float32), unit(x @ right), y, float(base))


def quality_score(model: QualityModel, text: Column, df: DataFrame) -> Column:
    """Score of a text column; labelled vectors and projection are broadcast (bounded by the constants)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores([t if isinstance(t, str) else None for t in texts]), dtype=float)

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. No shuffle of texts.

    Every document is compared with every labelled vector, in blocks. A null, empty or blank text
    gets the base share. Repeated rows score alike; other columns are ignored."""
    model = fit_quality(docs, labels)
    rows = without(docs, "score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(model, F.col("text"), docs).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
