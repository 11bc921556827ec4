"""Alternating fits against a dense full-batch version, numerical slopes, and recovery at the full number of epochs."""

import numpy as np
import pytest

from tessella.operators import alternating


def test_slopes_equal_differences():
    rng = np.random.default_rng(0)
    eta, y = rng.normal(size=50) * 2, rng.uniform(0.02, 0.98, 50)
    for kind, value in (("beta", y), ("binary", np.round(y))):
        low, high = (alternating.channel(kind, eta + d, value)[0] for d in (-1e-6, 1e-6))
        assert np.allclose((high - low) / 2e-6, alternating.channel(kind, eta, value)[1], atol=1e-4)


@pytest.mark.parametrize("phi", [10.0, 3.7])
def test_steps_equal_the_channel(phi):
    rng = np.random.default_rng(3)
    eta, y = np.concatenate([rng.normal(size=200) * 4, [-800, -20, 20, 800]]), rng.uniform(0, 1, 204)
    for kind, value in (("beta", y), ("binary", np.round(y))):
        assert np.allclose(alternating.STEPPERS[kind](value, phi)(eta), alternating.channel(kind, eta, value, phi)[1], rtol=1e-9, atol=1e-11)


def test_a_step_costs_less_than_the_channel_with_its_loss():
    """Losses are read at the last step only, and what depends on y is made once."""
    import timeit

    rng = np.random.default_rng(5)
    eta, y = rng.normal(size=8000), rng.uniform(0.01, 0.99, 8000)
    steps = alternating.STEPPERS["beta"](y, 10.0)
    assert 2 * min(timeit.repeat(lambda: steps(eta), number=5, repeat=5)) < min(timeit.repeat(lambda: alternating.channel("beta", eta, y), number=5, repeat=5))


def dense(y, kind, epochs, steps, seed=0):
    """The same model on a whole matrix: one gradient a step for all traits, then for all items."""
    there = np.isfinite(y)
    n, filled = there.sum(), np.where(there, y, 0.5)
    (theta,), (alpha, z) = alternating.start(*y.shape, seed)
    moments = {k: [0.0, 0.0] for k in "taz"}
    losses = []

    def move(name, value, grad, t, lr):
        m, v = moments[name]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        moments[name] = [m, v]
        return value * (1 - 0.01 * lr) - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    for e in range(epochs):
        for part in ("traits", "items"):
            for t in range(e * steps + 1, (e + 1) * steps + 1):
                loss, g = alternating.channel(kind, alpha * (theta[:, None] + z), filled)
                last, g = (loss * there).sum() / n, np.where(there, g, 0) / n
                if part == "traits":
                    theta = move("t", theta, (g * alpha).sum(1), t, 0.1)
                else:
                    ga, gz = (g * (theta[:, None] + z)).sum(0), (g * alpha).sum(0)
                    alpha, z = move("a", alpha, ga, t, 0.01), move("z", z, gz, t, 0.01)
            losses.append(last)
    return theta, alpha, z, np.array(losses).reshape(-1, 2).sum(1)


def cells(spark, y):
    rows = [(f"m{m:02d}", f"q{i:02d}", None if np.isnan(v) else float(v)) for (m, i), v in np.ndenumerate(y)]
    return spark.createDataFrame(rows, "model_id string, item_id string, y double").repartition(3)


@pytest.mark.parametrize("kind", ["beta", "binary"])
def test_half_epochs_in_tasks_equal_full_batches(spark, kind):
    rng = np.random.default_rng(1)
    y = rng.uniform(0.01, 0.99, (7, 9))
    y = np.round(y) if kind == "binary" else y
    y[2, 3] = y[5, 0] = np.nan
    models, items, history = alternating.fit(cells(spark, y), kind, epochs=3, steps=12)
    theta, alpha, z, losses = dense(y, kind, 3, 12)
    for got, want in ((models["theta"], theta), (items["alpha"], alpha), (items["z"], z), (history, losses)):
        assert np.allclose(got, want, atol=1e-9)


def test_traits_are_recovered_at_the_full_count(spark):
    rng = np.random.default_rng(4)
    theta, alpha, z = rng.normal(size=24), rng.uniform(0.6, 1.6, 40), rng.normal(size=40) * 0.8
    mu = 1 / (1 + np.exp(-alpha * (theta[:, None] + z)))
    y = rng.beta(10 * mu, 10 * (1 - mu))
    y[rng.random(y.shape) < 0.05] = np.nan
    models, items, history = alternating.fit(cells(spark, y).coalesce(2))
    assert len(history) == 50 and history[-1] < history[0]
    assert np.corrcoef(models["theta"], theta)[0, 1] > 0.98 and np.corrcoef(items["z"], z)[0, 1] > 0.95 and np.corrcoef(items["alpha"], alpha)[0, 1] > 0.8


def test_nothing_observed(spark):
    models, items, history = alternating.fit(cells(spark, np.full((2, 2), np.nan)))
    assert len(models) == len(items) == len(history) == 0


@pytest.mark.parametrize("kind", ["beta", "binary"])
def test_nodes_stand_for_cells(kind):
    """Gradients and losses of steps that visit some nodes, not 4,000 cells an item or 300 a model, are those of the cells."""
    rng = np.random.default_rng(6)
    theta, items = rng.uniform(-1.5, 1.5, 4000), np.stack([rng.uniform(0.3, 2.5, 300), rng.normal(size=300) / 2])
    y = rng.uniform(0.01, 0.99, (4000, 300))
    y = np.round(y) if kind == "binary" else y
    o = alternating.outcomes(kind, y)[0]
    constants = lambda rows: np.array([alternating.outcomes(kind, v)[1] for v in rows])
    some = [5, 17, 200]
    nodes = alternating._Items(kind, items[0, some], [(theta, o[:, k]) for k in some], constants(y[:, some].T), y.size, 10.0, 0.01, 100)
    cells = alternating.gradient_of("items", kind, theta[None], np.repeat(np.arange(3), 4000), np.tile(np.arange(4000), 3), y[:, some].T.ravel(), y.size, 10.0)
    assert len(nodes.theta) < 1000
    few = [3, 900, 2500, 3999]
    table = alternating._Models(kind, items, np.tile(np.arange(300), 4), o[few].ravel(), np.full(4, 300), constants(y[few]), y.size, 10.0)
    whole = alternating.gradient_of("models", kind, items, np.repeat(np.arange(4), 300), np.tile(np.arange(300), 4), y[few].ravel(), y.size, 10.0)
    for _ in range(5):
        own, trait = items[:, some] + rng.normal(size=(2, 3)) * 0.3, theta[None, few] + rng.normal(size=(1, 4)) * 0.3
        for got, want in ((nodes(own, True), cells(own, True)), (table(trait, True), whole(trait, True))):
            for a, b in zip(got, want):
                assert np.allclose(a * y.size, b * y.size, rtol=1e-10, atol=1e-8)
    assert not nodes.bad.any() and not table.bad.any()


@pytest.mark.parametrize("kind", ["beta", "binary"])
def test_steep_items_and_far_traits_are_done_by_cells(spark, monkeypatch, kind):
    """Means beyond the clamp have no slope, which no smooth sum can follow."""
    rng = np.random.default_rng(9)
    y = rng.uniform(0.01, 0.99, (60, 8))
    y = np.round(y) if kind == "binary" else y
    begin = rng.normal(size=(1, 60)) * 2, np.stack([np.linspace(-7, 7, 8), rng.normal(size=8)])
    monkeypatch.setattr(alternating, "start", lambda *a: tuple(p.copy() for p in begin) if a[2] == 0 else None)
    eta = begin[1][0] * (begin[0].T + begin[1][1])
    assert (np.abs(eta) > 15).any() and (np.abs(eta) < 10).all(1).any()
    models, items, history = alternating.fit(cells(spark, y), kind, epochs=2, steps=7)
    theta, alpha, z, losses = dense(y, kind, 2, 7)
    for got, want in ((models["theta"], theta), (items["alpha"], alpha), (items["z"], z), (history, losses)):
        assert np.allclose(got, want, atol=1e-9)
