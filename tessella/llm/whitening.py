"""Embedding whitening by an incremental eigendecomposition.

Every partition keeps the spectrum of its centred scatter and updates it by rank-one terms: those of a
block of rows (first reduced to at most one row a dimension by an orthogonal factorisation, which leaves
the scatter as it is) and the one for the shift of the mean. A rank-one update deflates what it does not
touch, solves the secular equation for the rest, and rebuilds the eigenvectors from the roots. Spectra
are combined in the same way, an update for each eigenpair of the other one and one for the means, in
rounds of ``FAN_IN``. One pass over all rows then projects the exactly centred vectors on the basis found
and sums the products: the Rayleigh-Ritz step on that basis gives the components to double precision.
Whatever the number of rows, the driver gets sums and one spectrum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fresh_path, remove, write_and_forget
from tessella.llm.vectors import matrix, prepared

SCALE, OFFSET = 1024, 100_000  # fixed values of the integer form
COMPONENTS = 8
BLOCK_ROWS = 4096
FAN_IN = 32
FLAT = 1e-12  # components below this share of the largest eigenvalue can't be scaled to one


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_j^2 / (d_j - t) for rising ``d``, one above each: the pole nearest to each, and the distance from it.

    Distances are halved until they stand still, from the pole in whose half of the gap the root lies.
    """
    z2 = z * z
    gap = np.append(np.diff(d), z2.sum())
    middle = d + gap / 2
    at_middle = 1 + (z2 / (d - middle[:, None])).sum(1)
    right = (at_middle < 0) & (np.arange(len(d)) < len(d) - 1)  # the root is nearer to the next pole
    pole = np.arange(len(d)) + right
    last = (np.arange(len(d)) == len(d) - 1) & (at_middle < 0)
    low = np.where(right, -gap / 2, np.where(last, gap / 2, 0.0))
    high = np.where(right, 0.0, np.where(last, gap, gap / 2))
    apart = d - d[pole][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(200):
            t = (low + high) / 2
            if ((t == low) | (t == high)).all():
                break
            rises = 1 + (z2 / (apart - t[:, None])).sum(1) > 0
            low, high = np.where(rises, low, t), np.where(rises, t, high)
    t = (low + high) / 2
    edge = np.where(right, -np.finfo(float).tiny, np.finfo(float).tiny)
    return pole, np.where(t == 0, edge, t)


def rank_one(values: np.ndarray, vectors: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``vectors @ diag(values) @ vectors.T + w w.T``."""
    z = vectors.T @ w
    norm2 = float(z @ z)
    if norm2 == 0:
        return values, vectors
    tol = 8 * np.finfo(float).eps * max(float(np.abs(values).max(initial=0)), norm2)
    d, vectors = values.copy(), vectors.copy()
    live = np.abs(z) * np.sqrt(norm2) > tol  # the rest stays as it is
    before = -1
    for i in np.flatnonzero(live):  # of two equal values one can be turned out of the update
        if before >= 0 and d[i] - d[before] <= tol:
            r = np.hypot(z[before], z[i])
            c, s = z[i] / r, z[before] / r
            vectors[:, [before, i]] = np.stack((c * vectors[:, before] - s * vectors[:, i], s * vectors[:, before] + c * vectors[:, i]), 1)
            z[before], z[i], live[before] = 0.0, r, False
        before = i
    on = np.flatnonzero(live)
    if len(on):
        p, q = d[on], z[on]
        pole, shift = secular_roots(p, q)
        minus = (p[:, None] - p[pole]) - shift  # d_j - root_i, without cancellation
        # The weights for which these roots are exact: vectors built from them are orthogonal.
        below = p[:, None] - p[None, :]
        np.fill_diagonal(below, 1.0)
        ratio = -minus / -np.where(np.eye(len(p), dtype=bool), 1.0, below)
        weight = np.sqrt(np.abs(np.prod(ratio, axis=1)))
        turn = (np.copysign(weight, q)[:, None]) / minus
        turn /= np.linalg.norm(turn, axis=0)
        vectors[:, on] = vectors[:, on] @ turn
        d[on] = p[pole] + shift
    order = np.argsort(d, kind="stable")
    return d[order], vectors[:, order]


class Spectrum:
    """Number, mean and spectrum of the centred scatter of the rows seen so far."""

    def __init__(self, dim: int, n: int = 0, mean: np.ndarray | None = None, values: np.ndarray | None = None, vectors: np.ndarray | None = None):
        self.n = n
        self.mean = np.zeros(dim) if mean is None else mean
        self.values = np.zeros(dim) if values is None else values
        self.vectors = np.eye(dim) if vectors is None else vectors

    def _shift(self, n: int, mean: np.ndarray) -> None:
        self._update(np.sqrt(self.n * n / (self.n + n)) * (mean - self.mean))
        self.mean = self.mean + (n / (self.n + n)) * (mean - self.mean)
        self.n += n

    def _update(self, w: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, w)

    def add_rows(self, rows: np.ndarray) -> None:
        mean = rows.mean(0)
        centred = rows - mean
        for w in np.linalg.qr(centred, mode="r") if len(rows) > rows.shape[1] else centred:
            self._update(w)
        self._shift(len(rows), mean)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._update(np.sqrt(value) * vector)
        self._shift(other.n, other.mean)


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v).astype(np.int64) + OFFSET


SPECTRA = "part int, n long, sums array<string>, mean array<double>, vals array<double>, vecs array<double>"
SUMS = "part int, total array<double>"


def _fit_part(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums, held, n_held = Spectrum(dim), [0] * dim, [], 0

        def take() -> None:
            nonlocal held, n_held
            if n_held:
                spectrum.add_rows(np.concatenate(held).astype(np.float64))
            held, n_held = [], 0

        for batch in batches:
            x = integers(matrix(batch.column(0)))
            sums = [a + int(b) for a, b in zip(sums, x.sum(0))] if len(x) else sums
            for s in range(0, len(x), BLOCK_ROWS):
                held.append(x[s : s + BLOCK_ROWS])
                n_held += len(held[-1])
                if n_held >= BLOCK_ROWS:
                    take()
        take()
        if spectrum.n:
            yield _spectrum_row(spectrum, sums)

    return run


def _spectrum_row(s: Spectrum, sums: list[int]) -> pa.RecordBatch:
    cols = {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([s.n], pa.int64()), "sums": [[str(x) for x in sums]], "mean": [s.mean.tolist()], "vals": [s.values.tolist()], "vecs": [s.vectors.ravel().tolist()]}
    return pa.RecordBatch.from_pydict(cols)


def _spectrum_of(r: dict) -> Spectrum:
    dim = len(r["mean"])
    return Spectrum(dim, r["n"], np.array(r["mean"]), np.array(r["vals"]), np.array(r["vecs"]).reshape(dim, dim))


def _merge_spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, sums = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            if found is None:
                found, sums = _spectrum_of(r), [int(x) for x in r["sums"]]
            else:
                found.merge(_spectrum_of(r))
                sums = [a + int(b) for a, b in zip(sums, r["sums"])]
    if found is not None:
        yield _spectrum_row(found, sums)


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        x = matrix(batch.column("total"))
        total = x.sum(0) if total is None else total + x.sum(0)
    if total is not None:
        yield _sum_row(total)


def _sum_row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "total": [total.ravel().tolist()]})


def _combined(rows: DataFrame, merge: Callable, ddl: str) -> dict | None:
    """The one row that is left when rows are merged in rounds of ``FAN_IN``; written between rounds."""
    spark, paths = rows.sparkSession, []
    while True:
        paths.append(fresh_path(spark, "spectra"))
        rows = write_and_forget(rows, paths[-1])
        n = rows.count()
        if n <= 1:
            break
        groups = -(-n // FAN_IN)
        rows = rows.repartition(groups, F.pmod("part", F.lit(groups))).mapInArrow(merge, ddl)
    got = rows.collect()
    remove(spark, paths)
    return got[0].asDict() if got else None


def _products(n: int, sums: list[int], basis: np.ndarray):
    """Sums of products of the centred vectors' coordinates in a basis, a row a partition."""
    whole, rest = _mean(n, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            x = integers(matrix(batch.column(0)))
            for s in range(0, len(x), BLOCK_ROWS):
                y = ((x[s : s + BLOCK_ROWS] - whole) - rest) @ basis
                total += y.T @ y
        yield _sum_row(total)

    return run


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and what is left, so that centring rounds once."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; None where a long can't hold it."""
    far = max((n * int(b) + abs(s) for b, s in zip(np.abs(x).max(0).tolist() if len(x) else [], sums)), default=0)
    near = int(np.abs(x - np.array([s // n for s in sums], np.int64)).max(initial=0)) + 1
    if far < 1 << 62 and (n * near) ** 2 * max(x.shape[1], 1) < 1 << 63:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(1).tolist()
    out = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(n: int, sums: list[int], scaled: np.ndarray, on: list[bool], explained: list[float | None], error: float | None):
    whole, rest = _mean(n, sums)
    k = len(on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(s, BLOCK_ROWS)
                x = integers(matrix(part.column(1)))
                y = ((x - whole) - rest) @ scaled
                m = len(x)
                ids, far = part.column(0).to_pylist(), deviations(x, n, sums)
                cols = [
                    pa.array(np.repeat(np.arange(m), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([n] * (m * k), pa.int64()), pa.array([v for v in far for _ in range(k)], pa.int64()),
                    pa.array(y.ravel(), mask=np.tile(~np.array(on), m)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ]
                cols[0] = pa.array([i for i in ids for _ in range(k)], pa.int64())
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def fitted(rows: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray, np.ndarray] | None:
    """Number, exact sums, falling eigenvalues and eigenvectors (columns) of the covariance of the rows' integer form."""
    only = rows.select("v")
    found = _combined(only.mapInArrow(_fit_part(dim), SPECTRA), _merge_spectra, SPECTRA)
    if found is None:
        return None
    n, sums = found["n"], [int(x) for x in found["sums"]]
    basis = np.linalg.qr(_spectrum_of(found).vectors)[0]
    total = np.array(_combined(only.mapInArrow(_products(n, sums, basis), SUMS), _add_sums, SUMS)["total"]).reshape(dim, dim) / n
    values, turn = np.linalg.eigh((total + total.T) / 2)
    return n, sums, values[::-1].copy(), (basis @ turn)[:, ::-1].copy()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries take no part; nor do entries too large
    for a long in integer form, or vectors of another length than most (of equally frequent lengths the
    longest counts). Repeated rows come out once each, null ids are kept. There are as many components as
    dimensions if these are fewer. Components with less than ``FLAT`` of the largest eigenvalue, such as all
    of those of one row or equal rows, have null in ``whitened``; without any other ``explained`` and
    ``identity_error`` are null too. A deviation beyond a long is null. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors, id_col, vector_col).where(~F.exists("v", lambda c: F.abs(c) >= F.lit(float(1 << 51))))
    size = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    fit = fitted(rows.where(F.size("v") == size["dim"]), size["dim"]) if size else None
    if fit is None:
        return spark.createDataFrame([], OUT)
    n, sums, values, basis = fit
    rows, k = rows.where(F.size("v") == size["dim"]), min(components, size["dim"])
    on = [bool(v > FLAT * values[0] and v > 0) for v in values[:k]]
    scaled = basis[:, :k] / np.sqrt(np.where(on, values[:k], 1.0))
    trace = float(values.sum())
    explained = [float(v) / trace if trace > 0 and any(on) else None for v in values[:k]]
    error = None
    if any(on):
        seen = np.array(_combined(rows.select("v").mapInArrow(_products(n, sums, scaled), SUMS), _add_sums, SUMS)["total"]).reshape(k, k) / n
        error = float(np.abs(seen - np.eye(k))[np.ix_(on, on)].max())
    return rows.mapInArrow(_whitened(n, sums, scaled, on, explained, error), OUT)
