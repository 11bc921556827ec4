"""Whitening against a dense eigendecomposition, rank-one updates against one too."""

import numpy as np
import pytest

from tessella.llm import queries, whitening

RNG = np.random.default_rng(5)


def dense(v):
    """Integer form, eigenvalues (falling), eigenvectors."""
    x = np.floor(1024 * v).astype(np.int64) + 100_000
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    return x, values[::-1], vectors[:, ::-1]


def check(got, ids, v, components=8):
    x, values, vectors = dense(v)
    n, sums, k = len(x), x.sum(0), min(components, v.shape[1])
    assert len(got) == n * k
    rows = {}
    for r in got:
        rows.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    far = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    want = (x - sums / n) @ vectors[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        mine = np.array([rows[i][c + 1][0]["whitened"] for i in ids])
        sign = np.sign(mine @ want[:, c])
        assert np.abs(mine - sign * want[:, c]).max() < 1e-8
    for i, d in zip(ids, far):
        for c in range(k):
            for r in rows[i][c + 1]:
                assert r["n"] == n and r["deviation"] == d and abs(r["explained"] / (values[c] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9


@pytest.mark.parametrize("dim,parts,block", [(64, 3, 4096), (12, 7, 50), (5, 40, 4096), (1, 2, 3)])
def test_whitening_equals_a_dense_decomposition(spark, monkeypatch, dim, parts, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    v = RNG.normal(size=(400, dim)) @ RNG.normal(size=(dim, dim))
    v[50:150] = v[0]  # ties
    rows = [(i, x.tolist(), "w", 1.0) for i, x in enumerate(v)]
    bad = [(-1, None, "w", 1.0), (-2, [None] * dim, "w", 1.0), (-3, [float("nan")] * dim, "w", 1.0), (-4, [float("inf")] * dim, "w", 1.0), (-5, [], "w", 1.0), (-6, [1.0] * (dim + 1), "w", 1.0), (-7, [1e300] * dim, "w", 1.0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, component string, v double").repartition(parts)
    check(whitening.whiten(table).collect(), range(400), v)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])] * 3, schema)).collect()
    assert len(one) == 6 and all((r["vec_id"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (None, 3, 0, None, None, None) for r in one)
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), float(2 * k), 0.0]) for k in range(50)], schema)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-12 for r in line)
    assert abs(line[0]["explained"] - 1) < 1e-12


def test_deviations_are_exact():
    x = RNG.integers(90_000, 110_000, (30, 4))
    for n in (30, 10**9, 10**13):
        sums = [int(s) * (n // 30) for s in x.sum(0)]
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
        assert whitening.deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]


def test_rank_one_updates():
    for k in range(300):
        dim = int(RNG.integers(1, 20))
        values = np.sort(RNG.choice([0.0, 1.0, 1.0 + 1e-15, 2.0, 1e6, 1e-9], dim) if k % 2 else RNG.uniform(0, 5, dim))
        vectors = np.linalg.qr(RNG.normal(size=(dim, dim)))[0]
        w = RNG.normal(size=dim) * 10.0 ** RNG.integers(-6, 4)
        if k % 3 == 0:
            w = vectors[:, 0] * 3  # all but one value are deflated
        found, turned = whitening.rank_one(values, vectors, w)
        whole = (vectors * values) @ vectors.T + np.outer(w, w)
        size = np.abs(whole).max()
        assert np.abs(turned.T @ turned - np.eye(dim)).max() < 1e-12
        assert np.abs((turned * found) @ turned.T - whole).max() < 1e-12 * size * dim
        assert (np.diff(found) >= 0).all() and np.abs(found - np.linalg.eigvalsh(whole)).max() < 1e-12 * size * dim


def test_spectra_combine_to_the_whole():
    rows = RNG.normal(size=(700, 16)) @ RNG.normal(size=(16, 16)) + 100_000
    parts = [whitening.Spectrum(16) for _ in range(4)]
    for p, part in zip(parts, np.array_split(rows, [3, 200, 210])):
        p.add_rows(part)
    for p in parts[1:]:
        parts[0].merge(p)
    c = rows - rows.mean(0)
    assert np.abs((parts[0].vectors * parts[0].values) @ parts[0].vectors.T - c.T @ c).max() < 1e-9 * np.abs(c.T @ c).max()
    assert parts[0].n == 700 and np.abs(parts[0].mean - rows.mean(0)).max() < 1e-9


def test_query_equals_a_dense_decomposition(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    check(queries.QUERIES["op13_whitening"](spark, sf_dir).collect(), [r["vec_id"] for r in table], np.array([r["embedding"] for r in table], np.float32).astype(np.float64))
