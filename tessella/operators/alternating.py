"""Two-parameter models of one channel, fitted by alternating many steps on traits and on items.

Given the items, traits of models do not meet in the loss, nor do items given the traits; only the number of cells, its
divisor, is common to all. So the steps of one half-epoch run inside tasks, on whole models or whole items, and an epoch is
two passes over the cells whatever the number of steps. Parameters and optimiser state, a few numbers per model or item,
go through the driver between passes; cells stay in two layouts, a row per model and a row per item.

A step does not visit cells. The slope of a cell is D(eta) + o M(eta), with ``o`` its outcome, and smooth in the trait. So over
a short panel of traits it is a polynomial to rounding, given by its values at Chebyshev nodes, and a sum over cells is one
too. Given the items, a model's gradient is tabulated on the panel where its trait lies, from values at nodes that all models
share; given the traits, an item's cells become weights of nodes. What leaves the range where this holds is done cell by cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.latent import _SHIFT, CLAMP, PHI, _expit, beta_nll, digamma, lgamma
from tessella.operators.structure import checkpointed

# Fixed values of the analysis.
EPOCHS, STEPS, LR_MODELS, LR_ITEMS = 50, 100, 0.1, 0.01
CELLS = 2_000_000  # cells a task
BLOCK = 8_192  # cells that take their steps together: few enough for their arrays to stay in a core's cache
DECAY, KEEP_MEAN, KEEP_SQUARE, SMALL = 0.01, 0.9, 0.999, 1e-8
NODES, REACH = 16, 0.6  # of a panel: nodes and half-width in the logit, whose poles lie pi away; what is cut off is of 1e-14
TILE = 64  # models that are multiplied together
FAR = 30.0  # logits beyond this stay there in tables


def channel(kind: str, eta: np.ndarray, y: np.ndarray, phi: float = PHI) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each cell and its slope in ``eta``, the logit of the mean: ``beta`` (precision ``phi``) or ``binary``."""
    mu = _expit(eta)
    if kind == "binary":
        return np.logaddexp(0, eta) - y * eta, mu - y
    inside = (mu > CLAMP) & (mu < 1 - CLAMP)
    mu, y = np.clip(mu, CLAMP, 1 - CLAMP), np.clip(y, CLAMP, 1 - CLAMP)
    slope = phi * (digamma(mu * phi) - digamma((1 - mu) * phi) - np.log(y) + np.log1p(-y))
    return beta_nll(y, mu, phi), np.where(inside, slope * mu * (1 - mu), 0.0)


def descend(own: np.ndarray, mean: np.ndarray, square: np.ndarray, gradient, taken: int, steps: int, lr: float) -> np.ndarray:
    """``steps`` of Adam with decoupled decay on ``own`` in place, ``taken`` steps into the run; losses of the last step's start."""
    loss = np.zeros(own.shape[1])
    for t in range(taken + 1, taken + steps + 1):
        loss, g = gradient(own, t == taken + steps)
        mean += (1 - KEEP_MEAN) * (g - mean)
        square += (1 - KEEP_SQUARE) * (g * g - square)
        own *= 1 - lr * DECAY
        own -= lr / (1 - KEEP_MEAN**t) * mean / (np.sqrt(square / (1 - KEEP_SQUARE**t)) + SMALL)
    return loss


def start(n_models: int, n_items: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Traits (1 x models) from N(0, 1); slopes 1 and shifts 0 of items (2 x items), each with noise of 0.1."""
    rng = np.random.default_rng(seed)
    traits = rng.standard_normal((1, n_models))
    return traits, np.stack([1 + 0.1 * rng.standard_normal(n_items), 0.1 * rng.standard_normal(n_items)])


def gradient_of(side: str, kind: str, other: np.ndarray, row: np.ndarray, at: np.ndarray, y: np.ndarray, n_cells: int, phi: float):
    """Losses and gradients by own entry, for cells (``row``: own entry, rising; ``at``: the other side's) divided by all cells' number.

    Sums of what the steps don't change are made once.
    """
    first = np.flatnonzero(np.diff(row, prepend=-1))
    there, size = row[first], np.diff(np.append(first, len(row)))
    steps = STEPPERS[kind](y, phi)
    against = other[:, at]

    def total(v: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(width)
        out[there] = np.add.reduceat(v, first) / n_cells
        return out

    def run(own: np.ndarray, with_loss: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        mine = np.repeat(own[:, there], size, 1)
        theta, (slope, shift) = (mine[0], against) if side == "models" else (against[0], mine)
        place = theta + shift
        eta = slope * place
        g = steps(eta)
        width = own.shape[1]
        loss = total(channel(kind, eta, y, phi)[0], width) if with_loss else None
        return loss, np.stack([total(g * slope, width)] if side == "models" else [total(g * place, width), total(g * slope, width)])

    return run


def _logistic(x: np.ndarray) -> np.ndarray:
    """As ``_expit``, by the exponential, which is quicker; beyond 700 it is 0 or 1 anyway."""
    return 1 / (1 + np.exp(np.clip(-x, -700, 700)))


def _binary_steps(y: np.ndarray, phi: float):
    return lambda eta: _logistic(eta) - y


def _digamma_gap(a: np.ndarray, b: np.ndarray, phi: float) -> tuple[np.ndarray, np.ndarray]:
    """digamma(a) - digamma(b), where a + b = phi, with one recurrence and one logarithm; and a b.

    The difference is log(za / zb) + series(za) - series(zb) - sum over k < SHIFT of (b - a) / ((a + k) (b + k)),
    za = a + SHIFT; (a + k) (b + k) = a b + k phi + k k.
    """

    def series(z: np.ndarray) -> np.ndarray:
        w = 1 / z
        q = w * w
        return -0.5 * w - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q / 240)))

    ab = a * b
    low = 0.0
    for k in range(0, _SHIFT, 2):  # two reciprocals by one division
        p, q = ab + k * (phi + k), ab + (k + 1) * (phi + k + 1)
        low = low + (p + q) / (p * q)
    za, zb = a + _SHIFT, b + _SHIFT
    return np.log(za / zb) + series(za) - series(zb) - (b - a) * low, ab


def _beta_steps(y: np.ndarray, phi: float):
    """The slope of ``channel`` with what depends on ``y`` made once."""
    y = np.clip(y, CLAMP, 1 - CLAMP)
    odds = np.log1p(-y) - np.log(y)

    def run(eta: np.ndarray) -> np.ndarray:
        mu = _logistic(eta)
        inside = (mu > CLAMP) & (mu < 1 - CLAMP)
        mu = np.clip(mu, CLAMP, 1 - CLAMP)
        a = mu * phi
        diff, ab = _digamma_gap(a, phi - a, phi)
        return np.where(inside, (diff + odds) * ab * (1 / phi), 0.0)  # phi mu (1 - mu) = a b / phi

    return run


STEPPERS = {"binary": _binary_steps, "beta": _beta_steps}


def _beta_parts(eta: np.ndarray, phi: float) -> tuple[np.ndarray, np.ndarray]:
    diff, ab = _digamma_gap(phi * _logistic(eta), phi * _logistic(-eta), phi)
    m = ab / phi
    return diff * m, m


def _beta_losses(eta: np.ndarray, phi: float) -> tuple[np.ndarray, np.ndarray]:
    a, b = phi * _logistic(eta), phi * _logistic(-eta)
    return lgamma(a) + lgamma(b) - lgamma(np.array(phi)), a


# By channel: D and M of the slope, the same of the loss, and the logit up to which no mean is clamped.
PARTS = {
    "binary": (lambda eta, phi: (_logistic(eta), np.ones_like(eta)), lambda eta, phi: (np.logaddexp(0, eta), eta), np.inf),
    "beta": (_beta_parts, _beta_losses, np.log((1 - CLAMP) / CLAMP) - 1e-6),
}


def outcomes(kind: str, y: np.ndarray, phi: float = PHI) -> tuple[np.ndarray, float]:
    """``o`` of each cell, and the sum of what their losses have besides D + o M."""
    if kind == "binary":
        return -y, 0.0
    y = np.clip(y, CLAMP, 1 - CLAMP)
    return np.log1p(-y) - np.log(y), float(np.sum(np.log(y) - (phi - 1) * np.log1p(-y)))


_POINTS = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
_COEFFICIENTS = np.cos(np.pi * np.outer(np.arange(NODES), np.arange(NODES) + 0.5) / NODES) * 2 / NODES  # times values at the nodes
_COEFFICIENTS[0] /= 2


def _series(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Chebyshev series (coefficients x rows) at a place for each row."""
    near, far, two = np.zeros_like(x), np.zeros_like(x), 2 * x
    for k in range(NODES - 1, 0, -1):
        near, far = two * near - far + c[k], near
    return x * near - far + c[0]


def weights_of(theta: np.ndarray, o: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Traits, weights of D and weights of M that stand for an item's cells: nodes of panels of this half-width, or the cells if these are fewer."""
    low = theta.min()
    panels = int(min((theta.max() - low) // (2 * half) + 1, len(theta)))
    if panels * NODES >= len(theta):
        return theta, np.ones(len(theta)), o
    moments, t = np.zeros((panels, NODES, 2)), np.empty((NODES, BLOCK))
    panel = np.minimum(((theta - low) / (2 * half)).astype(np.int32), panels - 1)
    order = np.argsort(panel, kind="stable")
    for k in range(0, len(theta), BLOCK):
        some = order[k : k + BLOCK]
        where = panel[some]
        n, x = len(some), (theta[some] - low) / half - (2 * where + 1)
        values = np.stack([np.ones(n), o[some]], 1)
        t[0, :n], t[1, :n], two = 1, x, 2 * x
        for j in range(2, NODES):
            np.multiply(two, t[j - 1, :n], out=t[j, :n])
            t[j, :n] -= t[j - 2, :n]
        cuts = np.flatnonzero(np.diff(where)) + 1
        for i, end in zip(np.append(0, cuts), np.append(cuts, n)):
            moments[where[i]] += t[:, i:end] @ values[i:end]
    d, m = (_COEFFICIENTS.T @ moments).transpose(2, 0, 1).reshape(2, -1)
    return (low + half * (2 * np.arange(panels)[:, None] + 1 + _POINTS)).ravel(), d, m


class _Items:
    """Losses and gradients of some items, for ``descend``; ``bad`` are those that left the range of their weights."""

    def __init__(self, kind: str, slopes: np.ndarray, cells: list[tuple[np.ndarray, np.ndarray]], constants: np.ndarray, n_cells: int, phi: float, lr: float, steps: int):
        self.slope_parts, self.loss_parts, self.far = PARTS[kind]
        self.limit, self.phi, self.n_cells, self.constants = np.abs(slopes) + 1.05 * lr * steps, phi, n_cells, constants
        self.ends = np.array([(t.min(), t.max()) for t, _ in cells]).T
        found = [weights_of(t, o, REACH / limit) for (t, o), limit in zip(cells, self.limit)]
        self.theta, self.d, self.m = (np.concatenate(x) for x in zip(*found))
        self.size = np.array([len(t) for t, _, _ in found])
        self.first = np.cumsum(self.size) - self.size
        self.bad = np.zeros(len(cells), bool)

    def _total(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.first) / self.n_cells

    def __call__(self, own: np.ndarray, with_loss: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        self.bad |= ~((np.abs(own[0]) <= self.limit) & (np.abs(own[0] * (self.ends + own[1])).max(0) < self.far))
        slope, shift = np.repeat(own, self.size, 1)
        place = self.theta + shift
        eta = np.clip(slope * place, -FAR, FAR) if self.far < np.inf else slope * place
        d, m = self.slope_parts(eta, self.phi)
        g, loss = self.d * d + self.m * m, None
        if with_loss:
            d, m = self.loss_parts(eta, self.phi)
            loss = self._total(self.d * d + self.m * m) + self.constants / self.n_cells
        return loss, np.stack([self._total(g * place), self._total(g * slope)])


class _Models:
    """Losses and gradients of some models, for ``descend``; ``bad`` are those whose cells may reach the clamp.

    Panels are half as far apart as they are wide, so that a trait near a border stays in its panel.
    """

    TABLES = 64  # panels whose tables are kept

    def __init__(self, kind: str, items: np.ndarray, at: np.ndarray, o: np.ndarray, size: np.ndarray, constants: np.ndarray, n_cells: int, phi: float):
        self.slope_parts, self.loss_parts, self.far = PARTS[kind]
        self.items, self.at, self.o, self.size, self.first, self.constants, self.n_cells, self.phi = items, at, o, size, np.cumsum(size) - size, constants, n_cells, phi
        steepest = max(float(np.abs(items[0]).max()), 1e-3)
        with np.errstate(divide="ignore"):
            room = self.far / np.abs(items[0])
        self.safe = (-room - items[1]).max(), (room - items[1]).min()
        self.half, self.tables = REACH / steepest, {}
        self.centre, self.c = np.full(len(size), np.inf), np.zeros((NODES, len(size)))
        self.dense, n_items = None, items.shape[1]
        if len(size) * n_items <= 4 * len(at):  # as a matrix, counts and outcomes of each item
            place = np.repeat(np.arange(len(size)), size) * n_items + at
            self.dense = np.concatenate([np.bincount(place, v, len(size) * n_items).reshape(-1, n_items) for v in (None, o)], 1)
        self.bad = np.zeros(len(size), bool)

    def _table(self, panel: int, loss: bool) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of D and of M on a panel, a row for each item."""
        if (panel, loss) not in self.tables:
            if len(self.tables) >= self.TABLES:
                self.tables.clear()
            slope, shift = self.items[:, :, None]
            eta = slope * (self.half * (panel + _POINTS) + shift)
            eta = np.clip(eta, -FAR, FAR) if self.far < np.inf else eta
            parts = (self.loss_parts if loss else self.slope_parts)(eta, self.phi)
            self.tables[panel, loss] = tuple((v if loss else slope * v) @ _COEFFICIENTS.T for v in parts)
        return self.tables[panel, loss]

    def _tabulate(self, out: np.ndarray, models: np.ndarray, panels: np.ndarray, loss: bool = False) -> None:
        """Coefficients of the models' sums over their cells on their panels, a few cells at a time."""
        for panel in np.unique(panels):
            mine = models[panels == panel]
            d, m = self._table(int(panel), loss)
            if self.dense is not None:
                both, tile = np.concatenate((d, m)), np.zeros((TILE, self.dense.shape[1]))
                for k in range(0, len(mine), TILE):  # one shape, so that a model's sum does not hang on others
                    part = mine[k : k + TILE]
                    tile[: len(part)] = self.dense[part]
                    out[:, part] = (tile @ both)[: len(part)].T / self.n_cells
                continue
            for part in (mine[k] for k in _few(self.size[mine])):
                size = self.size[part]
                first = np.cumsum(size) - size
                cell = np.repeat(self.first[part] - first, size) + np.arange(size.sum())
                at = self.at[cell]
                out[:, part] = (np.add.reduceat(d[at] + self.o[cell, None] * m[at], first, 0) / self.n_cells).T

    def __call__(self, own: np.ndarray, with_loss: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        theta = own[0]
        self.bad |= ~((theta >= self.safe[0]) & (theta <= self.safe[1]))
        there = np.where(np.isfinite(theta), theta, 0.0)
        moved = np.flatnonzero(~(np.abs(there - self.centre) <= self.half))
        if len(moved):
            panels = np.rint(there[moved] / self.half)
            self.centre[moved] = panels * self.half
            self._tabulate(self.c, moved, panels)
        x, loss = (there - self.centre) / self.half, None
        if with_loss:
            c = np.empty_like(self.c)
            self._tabulate(c, np.arange(len(theta)), np.rint(self.centre / self.half), True)
            loss = _series(c, x) + self.constants / self.n_cells
        return loss, _series(self.c, x)[None]


def _few(size: np.ndarray) -> list[np.ndarray]:
    """Places of rows, in groups of some ``BLOCK`` cells."""
    return np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // BLOCK)) + 1) if len(size) else []


def fit(cells: DataFrame, kind: str = "beta", epochs: int = EPOCHS, steps: int = STEPS, phi: float = PHI, seed: int = 0) -> tuple[pd.DataFrame, pd.DataFrame, list[float]]:
    """``models (model_id, theta)``, ``items (item_id, alpha, z)`` and the loss of each epoch (both halves' last steps).

    ``cells``: ``model_id, item_id, y``, y missing (null or NaN) where not observed; a repeated cell counts twice. The mean of
    a cell is the logistic of alpha (theta + z). Models and items without an observed cell take no part. A model's (item's) cells
    are one row, as they are one benchmark's. A fit that leaves the finite range is an error.
    """
    seen = checkpointed(cells.where(F.col("y").isNotNull() & ~F.isnan("y")).select("model_id", "item_id", F.col("y").cast("double").alias("y")))
    spark = cells.sparkSession
    models, items = ([r[0] for r in seen.select(k).distinct().orderBy(k).collect()] for k in ("model_id", "item_id"))
    coded = seen.join(spark.createDataFrame(list(zip(models, range(len(models)))), "model_id string, m int"), "model_id").join(spark.createDataFrame(list(zip(items, range(len(items)))), "item_id string, i int"), "item_id")
    n_cells, history = max(1, seen.count()), []
    parts = max(spark.sparkContext.defaultParallelism, n_cells // CELLS)  # adaptive merging would put few cells in one task, which has many steps to do

    def in_bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells of a model or item as bytes, with their outcomes; numbers of an array would be copied one by one in each pass."""
        for f in frames:
            made = [outcomes(kind, y, phi) for y in f["y"]]
            yield pd.DataFrame({"own": f["own"], "at": [a.astype(np.int32).tobytes() for a in f["at"]], "y": [y.astype(float).tobytes() for y in f["y"]], "o": [o.tobytes() for o, _ in made], "c": [c for _, c in made]})

    def pack(own: str, other: str) -> DataFrame:
        cells = coded.repartition(parts, own).groupBy(own).agg(F.sort_array(F.collect_list(F.struct(other, "y"))).alias("_c")).select(F.col(own).alias("own"), F.col(f"_c.{other}").alias("at"), F.col("_c.y").alias("y"))
        return checkpointed(cells.mapInPandas(in_bytes, "own int, at binary, y binary, o binary, c double"))

    layouts = {"models": pack("m", "i"), "items": pack("i", "m")}
    params = dict(zip(("models", "items"), start(len(models), len(items), seed)))
    state = {s: (np.zeros_like(p), np.zeros_like(p)) for s, p in params.items()}
    for epoch in range(epochs if models else 0):
        total = 0.0
        for side, other, lr in (("models", "items", LR_MODELS), ("items", "models", LR_ITEMS)):
            sent = spark.sparkContext.broadcast((params[side], *state[side], params[other]))  # a few numbers per model and item

            def half(frames: Iterator[pd.DataFrame], side=side, lr=lr, sent=sent, taken=epoch * steps) -> Iterator[pd.DataFrame]:
                p, mean, square, against = sent.value

                def run(ids: np.ndarray, gradient) -> tuple[np.ndarray, np.ndarray]:
                    own, avg, sq = p[:, ids].copy(), mean[:, ids].copy(), square[:, ids].copy()
                    with np.errstate(all="ignore"):  # of rows that are done again
                        loss = descend(own, avg, sq, gradient, taken, steps, lr)
                    return loss, np.concatenate([own, avg, sq])

                for whole in frames:
                    numbers = {c: [np.frombuffer(b, d) for b in whole[c]] for c, d in (("at", np.int32), ("y", float), ("o", float))}
                    size = np.array([len(a) for a in numbers["at"]])
                    for rows in [np.arange(len(whole))] if side == "models" else _few(np.minimum(size, BLOCK // 8)):  # an item has few nodes
                        ids, at, o = whole["own"].to_numpy()[rows], [numbers["at"][k] for k in rows], [numbers["o"][k] for k in rows]
                        constants = whole["c"].to_numpy()[rows]
                        if side == "models":
                            gradient = _Models(kind, against, np.concatenate(at), np.concatenate(o), size[rows], constants, n_cells, phi)
                        else:
                            gradient = _Items(kind, p[0, ids], [(against[0, a], b) for a, b in zip(at, o)], constants, n_cells, phi, lr, steps)
                        loss, values = run(ids, gradient)
                        for again in _few(np.where(gradient.bad, size[rows], 0)):  # cell by cell
                            mine = [k for k in again if gradient.bad[k]]
                            if mine:
                                cells = np.concatenate([at[k] for k in mine]), np.concatenate([numbers["y"][rows[k]] for k in mine])
                                loss[mine], values[:, mine] = run(ids[mine], gradient_of(side, kind, against, np.repeat(np.arange(len(mine)), size[rows][mine]), *cells, n_cells, phi))
                        yield pd.DataFrame({"own": ids, "loss": loss, **{f"v{k}": v for k, v in enumerate(values)}})

            width = 3 * len(params[side])
            got = layouts[side].mapInPandas(half, "own int, loss double, " + ", ".join(f"v{k} double" for k in range(width))).toArrow()  # a row per model or item
            sent.destroy()
            at, k = got["own"].to_numpy(), len(params[side])
            values, losses = np.stack([got[f"v{j}"].to_numpy() for j in range(width)]), np.zeros(params[side].shape[1])
            params[side][:, at], state[side][0][:, at], state[side][1][:, at] = values[:k], values[k : 2 * k], values[2 * k :]
            losses[at] = got["loss"].to_numpy()
            total += float(losses.sum())
        history.append(total)
        if not np.isfinite(total) or not all(np.isfinite(p).all() for p in params.values()):
            raise ValueError("the fit left the finite range")
    return pd.DataFrame({"model_id": models, "theta": params["models"][0]}), pd.DataFrame({"item_id": items, "alpha": params["items"][0], "z": params["items"][1]}), history
