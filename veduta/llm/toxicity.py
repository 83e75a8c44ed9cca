"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veduta.llm.samples import bounded_sample, held_out
from veduta.llm.tables import discard, stored, without
from veduta.llm.wordhash import blocks, mix, words

#: Confirmed documents of each label at most: toxic ones train, and a third of both calibrates.
PER_LABEL = 2000
BUCKETS = 1 << 20
#: Positives that a feature must be in, and gradient steps over all unlabelled rows.
LEAST_POSITIVES, STEPS = 3, 20
#: Leading bytes of a word that count as features of their own, beside the whole word.
PREFIXES = (4, 5, 6, 7, 8)
#: A feature has one bucket for each of these numbers of distinct words that a text has it in.
LEVELS = (1, 2, 3, 5)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[i for i in range(128) if not chr(i).isalnum()]] = True


def feature_rows(texts: Sequence[str | None], wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Per text its sorted distinct buckets: of its words (A-Z folded) and of their prefixes.

    With ``wanted`` (one flag per feature, before levels) only the features marked there."""
    kinds = BUCKETS // len(LEVELS)
    for first, end, data, starts in blocks(texts):
        value, begin, stop, row = words(data, starts, _SEPARATOR)
        of = np.repeat(np.arange(end - first), np.diff(row))
        _, once = np.unique(mix(value + of.astype(np.uint64)), return_index=True)  # distinct words of each text
        of, value, begin, stop = of[once], value[once], begin[once], stop[once]
        parts = [(mix(v) & np.uint64(kinds - 1)).astype(np.int64) for v in (value, *_prefix_hashes(data, begin, stop))]
        if wanted is not None:
            pairs = np.concatenate([of[m] * kinds + p[m] for p in parts for m in (wanted[p],)])
        else:
            pairs = np.concatenate([of * kinds + p for p in parts])
        pairs, count = np.unique(pairs, return_counts=True)
        pairs = np.sort(np.concatenate([pairs[count >= n] * len(LEVELS) + i for i, n in enumerate(LEVELS)]))
        at = np.searchsorted(pairs, np.arange(end - first + 1) * BUCKETS)
        for i in range(end - first):
            yield pairs[at[i] : at[i + 1]] & (BUCKETS - 1)


def _prefix_hashes(data: bytes, begin: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    folded = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
    out, h, length = [], np.full(len(begin), 0x51ED27, np.uint64), stop - begin
    for k in range(max(PREFIXES)):
        byte = folded[np.minimum(begin + k, len(raw) - 1)]
        h = np.where(k < length, h * np.uint64(0x100000001B3) ^ byte, h)
        if k + 1 in PREFIXES:
            out.append(h * np.uint64(31) + np.uint64(k))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class ToxicityModel:
    """``weights`` of the buckets ``chosen``; score = sigmoid(slope * (sum of weights + bias) + shift)."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, texts: Sequence[str | None]) -> np.ndarray:
        return np.array([self.weights[at].sum() for at in chosen_features(texts, self.chosen)], float) + self.bias

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        return _sigmoid(self.slope * self.margins(texts) + self.shift)


def chosen_features(texts: Sequence[str | None], chosen: np.ndarray) -> Iterator[np.ndarray]:
    """Per text the places in the sorted array ``chosen`` of those buckets that the text has."""
    wanted = np.zeros(BUCKETS // len(LEVELS), bool)
    wanted[chosen // len(LEVELS)] = True
    for f in feature_rows(texts, wanted):
        at = np.searchsorted(chosen, f)
        at[at == len(chosen)] = 0
        yield at[chosen[at] == f] if len(chosen) else at[:0]


@dataclass
class LossSums:
    """Over rows with margins g: sum of log(1 + exp(g)), and its gradient by feature and by the bias."""

    loss: float
    features: np.ndarray
    bias: float


def loss_sums(patterns: Sequence[np.ndarray], counts: np.ndarray, weights: np.ndarray, bias: float) -> LossSums:
    """LossSums of rows given as patterns (places of their features) and how many rows have each."""
    code = np.concatenate([*patterns, np.zeros(0, int)]).astype(int)
    row = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    g = np.bincount(row, weights[code], len(patterns)) + bias
    slope = counts * _sigmoid(g)
    return LossSums(float((counts * np.logaddexp(0, g)).sum()), np.bincount(code, slope[row], len(weights)), float(slope.sum()))


def choose_features(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int, least_z: float = 5.0) -> np.ndarray:
    """Buckets more frequent in the positives than in the unlabelled rows by a z-score of
    ``least_z``, in three positives at least."""
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    return np.flatnonzero((z > least_z) & (in_p >= LEAST_POSITIVES))


def nnpu_gradient(positive: Sequence[np.ndarray], unlabelled: LossSums, n_u: int, prior: float, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
    """(risk, its gradient by feature, and by the bias) of the non-negative PU risk with logistic loss.

    Risk: prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)). Where the bracket falls below 0,
    its gradient is reversed for the step, so that unlabelled toxic rows are not fitted away."""
    n_p = len(positive)
    p = loss_sums(positive, np.ones(n_p), weights, bias)
    held = np.bincount(np.concatenate([*positive, np.zeros(0, int)]).astype(int), minlength=len(weights))
    margin = float(weights @ held) + n_p * bias  # loss of +1 is loss of -1 less the margin
    bracket = unlabelled.loss / n_u - prior * p.loss / n_p
    down = unlabelled.features / n_u - prior * p.features / n_p
    down_bias = unlabelled.bias / n_u - prior * p.bias / n_p
    risk = prior * (p.loss - margin) / n_p + max(0.0, bracket)
    if bracket < 0:
        return risk, -down, -down_bias
    return risk, down + prior * (p.features - held) / n_p, down_bias + prior * (p.bias - n_p) / n_p


def fit_nnpu(positive: Sequence[np.ndarray], unlabelled: Callable[[np.ndarray, float], LossSums], n_u: int, prior: float, features: int, steps: int = STEPS, rate: float = 0.3, l2: float = 5e-2) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative PU risk, by Adam over full gradients.

    ``positive`` holds the features of every positive row, ``unlabelled`` sums losses and gradients
    over all unlabelled rows wherever they are. The rate falls off linearly."""
    w, b = np.zeros(features), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(features), np.zeros(features), 0.0, 0.0
    for t in range(1, steps + 1):
        _, g, gb = nnpu_gradient(positive, unlabelled(w, b), n_u, prior, w, b)
        g = g + l2 * w * prior
        m, v = 0.8 * m + 0.2 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.8 * mb + 0.2 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2, now = 1 - 0.8**t, 1 - 0.99**t, rate * (1 - (t - 1) / steps)
        w = w - now * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= now * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, float(b)


def fit_scale(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic calibration, lightly regularised: Newton steps, halved while they
    do not lower the loss."""
    centre, spread = float(margins.mean()), float(max(margins.std(), 1e-6))
    x = np.stack([(margins - centre) / spread, np.ones_like(margins)], axis=1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 5e-3 * (w @ w))

    w = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slope = max(w[0] / spread, 1e-3)
    return float(slope), float(w[1] - slope * centre)


#: Sums of doubles travel as whole multiples of 2 ** -SUM_BITS, so that their order does not matter.
SUM_BITS = 40


def positive_features(texts: DataFrame, positive: DataFrame) -> list[np.ndarray]:
    """The buckets of every positive document (bounded by PER_LABEL), found in the tasks that read them.

    A doc_id that repeats counts once, with the least of its rows."""

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = feature_rows([t if isinstance(t, str) else None for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "buckets": [f.astype("<i4").tobytes() for f in rows]})

    found = texts.join(F.broadcast(positive), "doc_id").mapInPandas(buckets, "doc_id long, buckets binary")
    one = found.groupBy("doc_id").agg(F.min("buckets").alias("buckets")).orderBy("doc_id")
    return [np.frombuffer(r["buckets"], "<i4").astype(int) for r in one.collect()]


def bucket_counts(texts: DataFrame, candidates: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all texts each candidate bucket is, and the number of texts.

    Tasks count into arrays of fixed size; sums per bucket reach the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(candidates)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            rows += len(batch)
            for at in chosen_features([t if isinstance(t, str) else None for t in batch["text"]], shared.value):
                total[at] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"place": np.append(at, -1).astype(np.int32), "n": np.append(total[at], rows)})

    sums = texts.select("text").mapInPandas(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(candidates), np.int64)
    rows = 0
    for r in sums:
        if r["place"] < 0:
            rows = r["n"]
        else:
            out[r["place"]] = r["n"]
    shared.unpersist()
    return out, rows


def feature_patterns(texts: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(pattern, n): the sets of chosen features that occur and the number of texts with each.

    The gradient needs no more of the unlabelled rows. Most have none or few of the features, so
    the table is much smaller than the texts; it is stored and never leaves the executors."""
    shared = texts.sparkSession.sparkContext.broadcast(chosen)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = chosen_features([t if isinstance(t, str) else None for t in batch["text"]], shared.value)
            seen = pd.Series([at.astype("<i4").tobytes() for at in rows], dtype=object).value_counts()
            yield pd.DataFrame({"pattern": seen.index, "n": seen.to_numpy()})

    return stored(texts.select("text").mapInPandas(reduce, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")))


def distributed_sums(patterns: DataFrame, features: int, n_u: int) -> Callable[[np.ndarray, float], LossSums]:
    """Loss sums over all unlabelled rows: every task sums its patterns, Spark the tasks' sums.

    One row per feature, one for the bias and one for the loss reach the driver."""
    scale = float(1 << SUM_BITS)

    def unlabelled(weights: np.ndarray, bias: float) -> LossSums:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(features + 2)
            for batch in batches:
                sums = loss_sums([np.frombuffer(p, "<i4") for p in batch["pattern"]], batch["n"].to_numpy(float), weights, bias)
                total += [*sums.features, sums.bias, sums.loss]
            at = np.flatnonzero(total)
            yield pd.DataFrame({"place": at.astype(np.int32), "part": np.rint(total[at] / n_u * scale).astype(np.int64)})

        out = np.zeros(features + 2)
        for r in patterns.mapInPandas(work, "place int, part long").groupBy("place").agg(F.sum("part").alias("part")).collect():
            out[r["place"]] = r["part"] / scale * n_u
        return LossSums(float(out[-1]), out[:features], float(out[-2]))

    return unlabelled


def calibration_margins(texts: DataFrame, confirmed: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """Margins and labels of the confirmed documents (bounded by PER_LABEL a label)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = shared.value.margins([t if isinstance(t, str) else None for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "margin": found})

    rows = texts.join(F.broadcast(confirmed), "doc_id").select("doc_id", "text", "toxic").mapInPandas(margins, "doc_id long, toxic int, margin double")
    one = rows.groupBy("doc_id", "toxic").agg(F.min("margin").alias("margin")).orderBy("doc_id").collect()
    return np.array([r["margin"] for r in one]), np.array([r["toxic"] for r in one], int)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> ToxicityModel:
    """Fits on confirmed toxic documents and, as unlabelled, on all texts outside the held-out fold
    but those that calibrate.

    Only confirmed documents are sampled, ``per_label`` of a label at most. Two thirds of the toxic
    ones train the classifier against the risk over every unlabelled text: executors count the
    candidate features in all texts, reduce each text to the features chosen, and sum gradients.
    The class prior is the share of toxic ones among all labelled training rows. The other third
    of the toxic documents, and as many of the others, calibrate scores: their labels set slope and
    shift only. Labels other than 0 and 1 count as none, and a document with several as toxic if one
    says so. Without any toxic row, or features that mark one, every score is the same."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = ToxicityModel(np.zeros(0, int), np.zeros(0), -40.0)
    if not shares.get(1):
        return nothing
    picked = bounded_sample(known, "toxic", per_label).withColumn("_part", F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(3)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out(F.col("doc_id")))
    calibrating = picked.where("_part = 0").select("doc_id", "toxic")
    unlabelled = texts.join(F.broadcast(calibrating.select("doc_id")), "doc_id", "left_anti")
    positive = positive_features(texts, picked.where("toxic = 1 and _part > 0").select("doc_id"))
    if not positive:
        return nothing
    in_p = np.bincount(np.concatenate(positive), minlength=BUCKETS)
    candidates = np.flatnonzero(in_p >= LEAST_POSITIVES)
    in_u, n_u = bucket_counts(unlabelled, candidates)
    chosen = candidates[choose_features(in_p[candidates], len(positive), in_u, n_u)]
    places = [np.searchsorted(chosen, f[np.isin(f, chosen)]) for f in positive]
    prior = min(max(shares[1] / sum(shares.values()), 1e-3), 0.9)
    patterns = feature_patterns(unlabelled, chosen)
    sums = distributed_sums(patterns, len(chosen), n_u)
    model = ToxicityModel(chosen, *fit_nnpu(places, sums, n_u, prior, len(chosen)))
    discard(patterns)
    margins, y = calibration_margins(texts, calibrating, model)
    if len(set(y)) == 2:
        model.slope, model.shift = fit_scale(margins, y)
    return model


def toxicity_score(model: ToxicityModel, text: Column, df: DataFrame) -> Column:
    """Score of a text column; the model (weights of the features chosen) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores([t if isinstance(t, str) else None for t in texts]), dtype=float)

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. No shuffle of texts.

    A null or empty text has no features and gets the score of its bias alone. Repeated rows score
    alike; other columns are ignored; an empty table gives none."""
    model = fit_toxicity(docs, labels)
    rows = without(docs, "score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(model, F.col("text"), docs).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
