"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veduta.llm.samples import bounded_sample, held_out
from veduta.llm.tables import without

#: Documents per language that the model is fitted on at most, and of all languages together;
#: many languages share the latter evenly.
SAMPLE_PER_LANGUAGE, SAMPLE = 400, 80_000
BINS = 1 << 14
UNDETERMINED = "und"
_ORDERS = (1, 2, 3)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of the whole lower-cased text; None without any letter.

    Characters other than letters count as one space per run, so words are set off by spaces."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    code = np.where(letter, code, np.uint32(32))[kept]
    counts = np.zeros(BINS, np.int64)
    for n in _ORDERS:
        if len(code) < n:
            break
        h = np.full(len(code) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ code[k : k + len(h)]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        counts += np.bincount(h & np.uint32(BINS - 1), minlength=BINS)
    return counts


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BINS x languages, sparse in values
    bias: np.ndarray
    temperature: float

    def features(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit TF-IDF values of the bins ``at``, with logarithmic term frequencies."""
        x = (1 + np.log(counts)) * self.idf[at]
        return (x / max(np.sqrt((x * x).sum()), 1e-12)).astype(np.float32)

    def logits(self, text: str | None) -> np.ndarray | None:
        counts = gram_counts(text)
        if counts is None:
            return None
        at = np.flatnonzero(counts)
        return self.features(at, counts[at]) @ self.weights[at] + self.bias

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for t in texts:
            z = self.logits(t if isinstance(t, str) else None) if self.languages else None
            if z is None:
                names.append(UNDETERMINED)
                scores.append(0.0)
            else:
                p = softmax(z[None, :] / self.temperature)[0]
                names.append(self.languages[int(p.argmax())])
                scores.append(float(p.max()))
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.01, epochs=4, seed=3) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic-net penalties: weights of a bin stay 0 until its accumulated
    gradient outgrows ``l1``. Rows are (bins, values, class); the last bin is the unpenalised bias."""
    z, n = np.zeros((BINS + 1, classes), np.float32), np.zeros((BINS + 1, classes), np.float32)
    order = np.random.default_rng(seed)
    penalty = np.full((BINS + 1, 1), l1)
    penalty[BINS] = 0

    def weights(at):
        zs, ns = z[at], n[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - penalty[at], 0)
        return -shrunk / ((beta + np.sqrt(ns)) / alpha + l2)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, BINS), np.append(x, 1.0)
            w = weights(at)
            p = softmax((x @ w)[None, :])[0]
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    all_weights = weights(np.arange(BINS + 1))
    return all_weights[:BINS].astype(np.float32), all_weights[BINS].astype(np.float32)


def calibrated_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood on rows the weights were not fitted on."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(5.0), 60))
    return float(min(grid, key=lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()))


def counted_grams(rows: DataFrame) -> DataFrame:
    """lang, doc_id, bins, counts: the non-zero gram counts of texts with letters, as bytes.

    Counted in the tasks that read the texts, so that no text reaches the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, key, text in zip(batch["lang"], batch["doc_id"], batch["text"], strict=True):
                if (c := gram_counts(text if isinstance(text, str) else None)) is not None:
                    at = np.flatnonzero(c)
                    out.append((lang, key, at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["lang", "doc_id", "bins", "counts"])

    return rows.select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(count, "lang string, doc_id long, bins binary, counts binary")


def fit_language_model(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, sample: int = SAMPLE) -> LanguageModel:
    """Fits on at most ``per_language`` documents of each language outside the held-out fold, and
    ``sample`` of all languages (a language has one at least).

    Every fifth of them is left to calibration. Rows without lang, doc_id or letters teach nothing;
    with no row at all the model knows no language and answers ``und``. Any number of languages
    is learned; each takes 4 * BINS bytes of the model and three times that while fitting."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    known = rows.where("lang is not null and doc_id is not null").agg(F.count_distinct("lang")).first()[0]
    most = max(1, min(per_language, sample // max(1, known)))
    taken = counted_grams(bounded_sample(rows, "lang", most)).orderBy("lang", "doc_id", "bins", "counts").collect()
    languages = sorted({r["lang"] for r in taken})
    number = {lang: i for i, lang in enumerate(languages)}
    counted = [(np.frombuffer(r["bins"], "<u2").astype(np.int32), np.frombuffer(r["counts"], "<u4").astype(np.float32), number[r["lang"]]) for r in taken]
    del taken
    if not counted:
        return LanguageModel([], np.ones(BINS), np.zeros((BINS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    seen = np.zeros(BINS)
    for at, *_ in counted:
        seen[at] += 1
    model = LanguageModel(languages, np.log((1 + len(counted)) / (1 + seen)) + 1, np.zeros((BINS, len(languages)), np.float32), np.zeros(len(languages), np.float32), 1.0)
    rows_ = [(at, model.features(at, n), y) for at, n, y in counted]
    fitted, kept = [r for i, r in enumerate(rows_) if i % 5 or len(rows_) < 20], [r for i, r in enumerate(rows_) if i % 5 == 0]
    model.weights, model.bias = fit_ftrl(fitted, len(languages))
    logits = np.stack([x @ model.weights[at] + model.bias for at, x, _ in kept])
    model.temperature = calibrated_temperature(logits, np.array([y for *_, y in kept]))
    return model


def predicted_language(model: LanguageModel, text: Column, df: DataFrame) -> Column:
    """struct<lang_pred, score> of a text column. The model (BINS x languages) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.predict(texts)

    return predict(text)


def identify_languages(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The documents with ``lang_pred`` and ``score`` added (existing such columns are replaced).

    Whole texts are scored, in the tasks that read them: no shuffle. A null text or one without
    letters gives ``und`` with score 0. Repeated rows score alike; an empty table gives none. Of
    texts without ``lang`` the model learns nothing, but they are judged like all others."""
    model = model or fit_language_model(docs)
    rows = without(docs, "lang_pred", "score", "_predicted")
    out = rows.withColumn("_predicted", predicted_language(model, F.col("text"), docs))
    return out.select("*", F.col("_predicted.lang_pred").alias("lang_pred"), F.col("_predicted.score").alias("score")).drop("_predicted")
