"""Embedding whitening: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations.

Three passes over the vectors: exact sums, triangular factors of the centred rows, and the moments
of the whitened rows. Only sums, one triangular matrix (dimensions squared) and one small
covariance reach the driver; the factors of the tasks are merged in rounds of ``FAN_IN``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veduta.llm.tables import discard, stored

#: Rows factored at once, and triangular factors merged by one task of a round.
BLOCK_ROWS, FAN_IN = 4096, 16
#: x = floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries whose x is larger than this are no exact doubles and count as not finite.
LARGEST = 1 << 53
_EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny


# --- vectors as integers ---------------------------------------------------------------------


def finite_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part; everything else is dropped.

    Dropped are null and empty vectors and those with a null or non-finite entry, or one
    whose x would not be exact (over 2**53). Null vec_ids and repeated rows stay."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) <= (LARGEST - OFFSET) / SCALE))
    return df.select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("vector")).where(F.coalesce(good, F.lit(False)) & (F.size("vector") > 0))


def commonest_length(vectors: DataFrame) -> int:
    """The length most vectors have; of lengths as common, the larger; 0 for an empty table."""
    row = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else 0


def _matrix(vectors: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return (np.floor(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * SCALE)).astype(np.int64) + OFFSET


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of x per dimension, exact at any size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * d, [0] * d
        for b in batches:
            x = _matrix(b.column(0), d)
            n += len(x)
            high = [h + int(s) for h, s in zip(high, (x >> 26).sum(axis=0), strict=True)]
            low = [v + int(s) for v, s in zip(low, (x & ((1 << 26) - 1)).sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"k": list(range(d)), "n": [n] * d, "s": [str((h << 26) + v) for h, v in zip(high, low, strict=True)]})

    rows = vectors.select("vector").mapInArrow(partial, "k long, n long, s string").groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    rows.sort(key=lambda r: r["k"])
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [0] * d)


@dataclass
class Centre:
    """n and sums; ``deviations`` gives n * x - S as exact integers, ``centred`` x - S / n."""

    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        largest = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        if largest < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squared deviations; None where a long cannot hold it."""
        y = self.deviations(x)
        if y.dtype == object or int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] >= 1 << 63:
            sums = [sum(int(v) ** 2 for v in r) for r in y]
            return [s if s < 1 << 63 else None for s in sums]
        return (y * y).sum(axis=1).tolist()


# --- blockwise QR ----------------------------------------------------------------------------


def triangular(rows: np.ndarray, r: np.ndarray | None = None) -> np.ndarray:
    """The triangular factor of ``rows`` below the factor ``r`` (square, zero rows added)."""
    out = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
    return np.vstack([out, np.zeros((out.shape[1] - len(out), out.shape[1]))]) if len(out) < out.shape[1] else out


def centred_factor(vectors: DataFrame, d: int, centre: Centre) -> np.ndarray:
    """R of the QR factorisation of all centred rows.

    Every task keeps one d x d factor, into which it folds blocks of rows; the tasks' factors are
    merged in rounds, each task of a round taking ``FAN_IN`` of them."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, pending, held = None, [], 0
        for b in batches:
            pending.append(centre.centred(_matrix(b.column(0), d)))
            held += len(pending[-1])
            if held >= BLOCK_ROWS:
                r, pending, held = triangular(np.vstack(pending), r), [], 0
        if held:
            r = triangular(np.vstack(pending), r)
        if r is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "r": [r.tobytes()]}, schema=pa.schema([("part", pa.int64()), ("r", pa.binary())]))

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        r = None
        for one in group.sort_values("part")["r"]:
            r = triangular(np.frombuffer(one).reshape(d, d), r)
        return pd.DataFrame({"part": [key[0]], "r": [r.tobytes()]})

    factors = stored(vectors.select("vector").mapInArrow(fold, "part long, r binary"))
    while factors.agg(F.max("part")).first()[0]:
        before, factors = factors, stored(factors.groupBy(F.expr(f"part div {FAN_IN}").alias("group")).applyInPandas(merge, "part long, r binary"))
        discard(before)
    out = np.frombuffer(factors.first()["r"]).reshape(d, d)
    discard(factors)
    return out


# --- singular values and directions of R -----------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit v and alpha with (I - 2 v v') x = alpha e_1."""
    norm = float(np.linalg.norm(x))
    if norm == 0:
        return np.zeros_like(x), 0.0
    v = x.copy()
    alpha = -math.copysign(norm, x[0])
    v[0] -= alpha
    return v / np.linalg.norm(v), alpha


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of U' R V, and the Householder vectors whose product is V."""
    a = r.astype(float).copy()
    d = len(a)
    diagonal, above, right = np.zeros(d), np.zeros(max(d - 1, 0)), []
    for k in range(d):
        v, diagonal[k] = _reflector(a[k:, k])
        a[k:, k + 1 :] -= 2 * np.outer(v, v @ a[k:, k + 1 :])
        if k + 1 < d:
            v, above[k] = _reflector(a[k, k + 1 :])
            a[k + 1 :, k + 1 :] -= 2 * np.outer(a[k + 1 :, k + 1 :] @ v, v)
            right.append(v)
    return diagonal, above, right


def _shifted(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference transform with shift ``s``: new q, new e, pivots d."""
    d = q[0] - s
    new_q, new_e, pivots = [], [], [d]
    for k, ek in enumerate(e):
        top = d + ek
        t = q[k + 1] / top if top else 0.0
        new_q.append(top)
        new_e.append(ek * t)
        d = d * t - s
        pivots.append(d)
    new_q.append(d)
    return new_q, new_e, pivots


def dqds(q: list[float], e: list[float]) -> list[float]:
    """All squared singular values of an unreduced bidiagonal block (squares ``q`` of the diagonal,
    ``e`` of the superdiagonal), to high relative accuracy, in falling order.

    The pivots of an unshifted transform are the reciprocals of the diagonal of the inverse, so the
    reciprocal of their sum is below the least value: a shift that keeps all quotients
    positive. A shift that fails by rounding is taken back. Values leave at the lower end when the
    last e no longer counts."""
    found, shift = [], 0.0
    while q:
        if len(q) == 1:
            found.append(shift + q[0])
            break
        if e[-1] <= _EPS * _EPS * (shift + q[-1]) or e[-1] <= _TINY:
            found.append(shift + q.pop())
            e.pop()
            continue
        q, e, pivots = _shifted(q, e, 0.0)
        if min(pivots) <= 0:
            continue
        s = (1 - 8 * len(q) * _EPS) / sum(1 / p for p in pivots)
        if s > _EPS * shift * 0.25:
            new_q, new_e, pivots = _shifted(q, e, s)
            if min(pivots) >= 0:
                q, e, shift = new_q, new_e, shift + s
    return sorted(found, reverse=True)


def twisted_vectors(a: np.ndarray, b: np.ndarray, value: float) -> Iterator[tuple[np.ndarray, float]]:
    """Vectors z with (B'B - value) z = gamma e_r from twisted factorisations, least |gamma| first,
    for the bidiagonal B of diagonal ``a`` and superdiagonal ``b``; and value's correction."""
    n = len(a)
    floor = _TINY * 1e20 + _EPS * _EPS * value

    def pivot(x: float) -> float:
        return x if abs(x) > floor else math.copysign(floor, x)

    s, p, lower, upper = np.zeros(n), np.zeros(n), np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s[0], p[-1] = -value, a[-1] ** 2 - value
    for i in range(n - 1):
        top = pivot(s[i] + a[i] ** 2)
        lower[i] = a[i] * b[i] / top
        s[i + 1] = b[i] ** 2 * (s[i] / top) - value
    for i in range(n - 2, -1, -1):
        top = pivot(b[i] ** 2 + p[i + 1])
        upper[i] = a[i] * b[i] / top
        p[i] = a[i] ** 2 * (p[i + 1] / top) - value
    gamma = s + p + value
    gamma[-1] = s[-1] + a[-1] ** 2
    for r in np.argsort(np.abs(gamma), kind="stable"):
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -upper[i] * z[i]
        size = np.linalg.norm(z)
        if np.isfinite(size):
            yield z / size, float(gamma[r] / size**2)


def leading_components(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of ``r`` (falling) and their right vectors as columns: at most ``most``
    of them, none whose singular value is zero to rounding. The entry of largest size is positive.

    Where the superdiagonal vanishes, R falls into blocks that are solved on their own. Vectors of
    nearly equal values are made orthogonal to those before them; of several twists, the first that
    leaves enough of a vector counts."""
    a, b, right = bidiagonalised(r)
    d = len(a)
    cuts = [0, *[i + 1 for i in range(d - 1) if abs(b[i]) <= _EPS * (abs(a[i]) + abs(a[i + 1]))], d]
    values = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        values += [(v, lo, hi) for v in dqds((a[lo:hi] ** 2).tolist(), (b[lo : hi - 1] ** 2).tolist())]
    values.sort(key=lambda v: (-v[0], v[1]))
    largest = values[0][0] if values else 0.0
    kept, vectors = [], []
    for value, lo, hi in values[:most]:
        if largest == 0 or value <= (d * _EPS) ** 2 * largest:
            break
        best, left = None, 1e-6
        for z, correction in twisted_vectors(a[lo:hi], b[lo : hi - 1], value):
            if abs(correction) > 4 * _EPS * value:  # one more step from the corrected value
                z = next(twisted_vectors(a[lo:hi], b[lo : hi - 1], value + correction), (z, 0.0))[0]
            full = np.zeros(d)
            full[lo:hi] = z
            full = full - sum((other * (other @ full) for other in vectors), np.zeros(d))
            if np.linalg.norm(full) > left:
                best, left = full / np.linalg.norm(full), np.linalg.norm(full)
            if left > 0.5:
                break
        if best is not None:
            best = best - sum((other * (other @ best) for other in vectors), np.zeros(d))
            kept.append(value)
            vectors.append(best / np.linalg.norm(best))
    out = np.array(vectors).reshape(-1, d).T
    for k in range(len(right) - 1, -1, -1):
        v = right[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    if out.size:
        out = out * np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])
    return np.array(kept), out


# --- whitening -------------------------------------------------------------------------------


@dataclass
class Whitening:
    """Centre, directions (dimensions x components, scaled to unit variance) and explained shares."""

    centre: Centre
    directions: np.ndarray
    explained: np.ndarray

    @property
    def d(self) -> int:
        return len(self.directions)

    def transform(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.directions


def fit_whitening(vectors: DataFrame, d: int, components: int = 8) -> Whitening:
    """Directions of largest variance over all ``vectors`` of length ``d``. Without variance there is none."""
    n, sums = exact_sums(vectors, d)
    if not n:
        return Whitening(Centre(0, sums), np.zeros((d, 0)), np.zeros(0))
    centre = Centre(n, sums)
    r = centred_factor(vectors, d, centre)
    squares, directions = leading_components(r, components)
    return Whitening(centre, directions * (math.sqrt(n) / np.sqrt(squares)), squares / max((r * r).sum(), _TINY))


def covariance(vectors: DataFrame, model: Whitening) -> np.ndarray:
    """Covariance of the whitened rows, divisor n, from the moments of the tasks around their own
    means, merged in the order of the tasks; one small row a task reaches the driver after
    moments have been merged by remainder of the task number."""
    shared = model

    def merged(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def packed(group: int, m: tuple) -> dict:
        return {"part": [group], "n": [m[0]], "mean": [m[1].tobytes()], "square": [m[2].tobytes()]}

    c = shared.directions.shape[1]

    def unpacked(row) -> tuple:
        return row["n"], np.frombuffer(row["mean"]), np.frombuffer(row["square"]).reshape(c, c)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if b.num_rows:
                z = shared.transform(_matrix(b.column(0), shared.d))
                off = z - z.mean(axis=0)
                own = len(z), z.mean(axis=0), off.T @ off
                total = own if total is None else merged(total, own)
        if total is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(packed(TaskContext.get().partitionId(), total)), schema=pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.binary()), ("square", pa.binary())]))

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for _, row in group.sort_values("part").iterrows():
            total = unpacked(row) if total is None else merged(total, unpacked(row))
        return pd.DataFrame(packed(key[0], total))

    schema = "part long, n long, mean binary, square binary"
    rows = vectors.select("vector").mapInArrow(moments, schema).groupBy(F.pmod("part", F.lit(256)).alias("group")).applyInPandas(merge, schema).orderBy("part").collect()
    total = unpacked(rows[0])
    for row in rows[1:]:
        total = merged(total, unpacked(row))
    return total[2] / total[0]


def whiten(df: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector that takes part and component.

    vec_id, component (from 1), n, deviation, whitened, explained, identity_error. Dropped are the
    vectors that ``finite_vectors`` drops and those of another length than the commonest. Components
    without variance are left out, so equal vectors, a single one and an empty table give no
    rows; a deviation beyond a long is null. Repeated rows and null ids stay; other columns are ignored."""
    vectors = finite_vectors(df, vec_id, vector)
    d = commonest_length(vectors)
    vectors = vectors.where(F.size("vector") == d)
    model = fit_whitening(vectors, d, components)
    c = model.directions.shape[1]
    error = float(np.abs(covariance(vectors, model) - np.eye(c)).max()) if c else 0.0
    schema = "vec_id " + vectors.schema["vec_id"].dataType.simpleString() + ", component int, n long, deviation long, whitened double, explained double"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), d)
            at = np.repeat(np.arange(len(x)), c)
            deviation = pa.array(model.centre.squares(x), pa.int64()).take(pa.array(at))
            columns = [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), model.centre.n)), deviation]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.transform(x).ravel()), pa.array(np.tile(model.explained, len(x)))], names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    rows = vectors if c else vectors.limit(0)
    return rows.mapInArrow(project, schema).withColumn("identity_error", F.lit(error))
