"""The slope analysis' fit against a dense version with missing cells, its flags and its agreement."""

import numpy as np
import pytest

from tessella.operators import dialect


def plain(ell, b, rounds):
    """Alternating least squares on a dense matrix with NaN for missing, by np.polyfit for lines."""
    n_models, n_items = ell.shape
    there = np.isfinite(ell)
    for _ in range(rounds):
        s, a = np.empty(n_models), np.empty(n_models)
        for m in range(n_models):
            slope, a[m] = np.polyfit(b[there[m]], ell[m, there[m]], 1)
            s[m] = -slope
        raw = np.array([(s[t] @ (a[t] - ell[t, i])) / (s[t] @ s[t]) for i, t in enumerate(there.T)])
        b = (raw - raw.mean()) / raw.std()
    return b


@pytest.fixture(scope="module")
def ell():
    rng = np.random.default_rng(2)
    slopes, easy = rng.uniform(0.5, 2, 12), rng.normal(size=70)
    out = slopes[:, None] * (rng.normal(size=12)[:, None] - easy) + rng.normal(size=(12, 70)) * 0.3
    out[rng.random(out.shape) < 0.1] = np.nan
    return out


@pytest.fixture(scope="module")
def obs(spark, ell):
    return spark.createDataFrame([(f"m{m:02d}", f"q{i:02d}", float(ell[m, i])) for m, i in zip(*np.nonzero(np.isfinite(ell)))] + [("m00", "q00", None)], "model_id string, item_id string, ell double")


def test_rounds_equal_a_dense_version(obs, ell):
    items, models, status = dialect.fit(obs, 3, 0.0)
    got = {(r["init"], r["item_id"]): r["b"] for r in items.collect()}
    scale = lambda v: (v - v.mean()) / v.std()
    p = np.clip(np.nanmean(np.where(np.isfinite(ell), ell > 0, np.nan), axis=0), 1e-4, 1 - 1e-4)
    for init, b in (("primary", scale(-np.nanmean(ell, axis=0))), ("binary", scale(np.log((1 - p) / p)))):
        want = plain(ell, b, 3)
        assert np.allclose([got[init, f"q{i:02d}"] for i in range(70)], want, atol=1e-9)
    assert {(r["n_iter"], r["converged"]) for r in status.collect()} == {(3, False)}


def test_both_starts_end_alike(obs):
    items, models, status = dialect.fit(obs, 100, 1e-4)
    assert all(r["converged"] and r["n_iter"] < 100 and r["moved"] < 1e-4 for r in status.collect())
    got = dialect.agreement(items, models).first()
    assert got["n_agree"] == 12 and not got["flipped"] and got["r_b"] > 0.99999 and got["max_s"] < 1e-2


def test_flags(spark):
    rows = [("a", 60, 1.0, 1.0, 1.0), ("b", 10, 1.0, 1.0, 1.0), ("c", 60, 0.0, -1.0, 1.0), ("d", 60, 1.0, 0.0, None), ("e", 60, 1.0, -2.0, 1.0)]
    got = {r["model_id"]: (r["flags"], r["fittable"]) for r in dialect.flagged(spark.createDataFrame(rows, "model_id string, n int, var_ell double, s double, theta double")).collect()}
    assert got == {"a": ("", True), "b": ("few_items", False), "c": ("degenerate_lowvar|neg_slope", False), "d": ("nonfinite|neg_slope", False), "e": ("neg_slope", True)}


def test_turned_signs_agree(spark):
    models = [(i, f"m{k}", 60, g * (1.0 + k), g * 0.5 * k * k, 1.0) for i, g in (("primary", 1), ("binary", -1)) for k in range(5)]
    items = [(i, f"q{k}", g * float(k)) for i, g in (("primary", 1), ("binary", -1)) for k in range(5)]
    got = dialect.agreement(spark.createDataFrame(items, "init string, item_id string, b double"), spark.createDataFrame(models, "init string, model_id string, n int, s double, theta double, var_ell double")).first()
    assert got["flipped"] and got["r_s"] == pytest.approx(1) and got["max_s"] == got["max_theta"] == got["max_b"] == 0


def test_a_constant_matrix_is_clamped_and_empty_is_empty(spark):
    flat = spark.createDataFrame([(f"m{m}", f"q{i}", 1.0) for m in range(3) for i in range(4)], "model_id string, item_id string, ell double")
    items, models, _ = dialect.fit(flat, 5)
    assert {r["b"] for r in items.collect()} == {0.0} and {r["s"] for r in models.collect()} == {0.0}
    assert {r["theta"] for r in models.collect()} == {None}
    items, models, status = dialect.fit(flat.limit(0), 5)
    assert items.count() == models.count() == status.count() == 0


def test_rounds_shuffle_no_cells(obs, monkeypatch):
    """Cells meet lines inside tasks: all that a round sums is a value per task, start and item."""
    seen = []
    kept = dialect._round
    monkeypatch.setattr(dialect, "_round", lambda models, b: seen.append((models.count(), b.shape)) or kept(models, b))
    dialect.fit(obs, 2, 0.0)
    assert seen == [(12, (2, 70))] * 2
