"""Whitening against exact integers and a dense eigenvalue solver."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veduta.llm.queries import QUERIES
from veduta.llm.whitening import Centre, bidiagonalised, dqds, finite_vectors, leading_components, triangular, whiten


def brute_force(vectors, components=8):
    """The contract by numpy: exact integers, then a dense symmetric solver."""
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((x * n - sums) ** 2).sum(axis=1)
    centred = ((x * n - sums) / n).astype(float)
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    return n, deviation, centred @ w / np.sqrt(e), e / np.trace(v)


def compare(rows, vectors, components=8):
    n, deviation, whitened, explained = brute_force(vectors, components)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == n * whitened.shape[1]
    for k in range(whitened.shape[1]):
        mine = np.array([got[i, k + 1]["whitened"] for i, _ in vectors])
        sign = np.sign(mine @ whitened[:, k])
        assert np.abs(mine - sign * whitened[:, k]).max() < 1e-8
    for (i, _), want in zip(vectors, deviation, strict=True):
        r = got[i, 1]
        assert r["n"] == n and r["deviation"] == want and r["identity_error"] < 1e-10
    for k, share in enumerate(explained):
        assert got[vectors[0][0], k + 1]["explained"] == pytest.approx(share, rel=1e-9)


def test_query_by_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(QUERIES["op13_whitening"](spark, sf_dir).collect(), rows)


def test_edge_cases_are_dropped_or_kept_as_stated(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.standard_normal(3).tolist()) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, math.inf, 0.0]), (104, [math.nan] * 3), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    rows = [(*r, "x") for r in good + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(7)
    compare(whiten(df).collect(), good)
    assert whiten(df.where("vec_id > 99")).count() == 0
    assert whiten(df.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    equal = spark.createDataFrame([(None, [1.0, 2.0])] * 9, "vec_id long, embedding array<float>")
    assert whiten(equal).count() == 0


def test_repeated_rows_and_null_ids_stay(spark):
    rows = [(None, [0.0, 1.0]), (None, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [3.0, 3.0])]
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in out) == [(0, 1), (0, 1), (0, 2), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]


def test_deviations_are_exact_beyond_longs():
    x = np.array([[2**52, 0], [-(2**52), 5], [7, 9]], np.int64)
    sums = [int(v) for v in x.sum(axis=0)]
    centre = Centre(3 * 10**6, [s * 10**6 for s in sums])
    want = [sum((3 * 10**6 * int(v) - s * 10**6) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert centre.squares(x) == [w if w < 2**63 else None for w in want]
    small = Centre(3, [300003, 6])
    assert small.squares(np.array([[100001, 2], [100001, 3]])) == [0, 9]


@pytest.mark.parametrize("n,d", [(300, 64), (40, 5), (3, 20), (500, 90)])
def test_values_and_directions_of_a_factor(n, d):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, d)) * np.exp(rng.uniform(-6, 3, d))
    blocks = None
    for part in np.array_split(x, 4):
        blocks = triangular(part, blocks)
    squares, directions = leading_components(blocks, 8)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    k = min(8, n, d)
    assert len(squares) == k and np.allclose(squares, s[:k] ** 2, rtol=1e-12)
    assert np.abs(np.abs((vt[:k] * directions.T).sum(axis=1)) - 1).max() < 1e-12
    assert np.abs(directions.T @ directions - np.eye(k)).max() < 1e-13


def test_dqds_keeps_relative_accuracy_of_small_values():
    a, b = np.array([1.0, 1e-4, 1e-9, 3.0]), np.array([0.5, 1e-3, 1e-8])
    values = dqds((a**2).tolist(), (b**2).tolist())
    assert math.prod(values) == pytest.approx(math.prod(a) ** 2, rel=1e-13)  # the determinant
    assert sum(values) == pytest.approx(float((a**2).sum() + (b**2).sum()), rel=1e-14)
    dense = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2
    assert values[:3] == pytest.approx(dense[:3].tolist(), rel=1e-6)


def test_bidiagonal_has_the_same_values():
    r = triangular(np.random.default_rng(2).standard_normal((30, 12)))
    a, b, _ = bidiagonalised(r)
    assert np.allclose(np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False), np.linalg.svd(r, compute_uv=False))


@pytest.mark.parametrize("values", [[5.0] * 3 + [1.0] * 2 + [0.0], [2.0] * 6, [0.0] * 4, [1.0, 1.0 + 1e-12, 1.0 - 1e-12, 0.1]])
def test_repeated_values_give_orthogonal_directions(values):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    r = triangular(np.diag(values) @ q)
    squares, directions = leading_components(r, 8)
    assert np.allclose(squares, [v * v for v in sorted(values, reverse=True) if v], rtol=1e-10)
    assert np.abs(directions.T @ directions - np.eye(len(squares))).max(initial=0) < 1e-12
    assert np.abs(r.T @ (r @ directions) - directions * squares).max(initial=0) < 1e-10


def test_finite_vectors_reads_floats(spark):
    df = spark.range(3).select("id", F.array(F.lit(1.5).cast("float")).alias("v"))
    assert finite_vectors(df, "id", "v").dtypes == [("vec_id", "bigint"), ("vector", "array<double>")]
