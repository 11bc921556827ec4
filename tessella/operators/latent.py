"""Latent-variable models on observed cells, residual ladders and gauge checks.

Parameters are one number per model or item and live on the driver; the cells never do. Each step
sends the parameters to the partitions, which return partial gradients already summed per model and
item; Spark adds these up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import guarded_corr

PHI = 10.0
CLAMP = 1e-6
_SHIFT = 8  # arguments are raised by so much before the asymptotic series


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive arguments."""
    x = np.asarray(x, float)
    low = sum(np.log(x + k) for k in range(_SHIFT))
    z = x + _SHIFT
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - low


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    low = sum(1 / (x + k) for k in range(_SHIFT))
    z = x + _SHIFT
    return np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - low


def beta_nll(y: np.ndarray, mu: np.ndarray, phi: float = PHI) -> np.ndarray:
    """Negative log likelihood of a Beta variable with mean ``mu`` and precision ``phi``."""
    a, b = mu * phi, (1 - mu) * phi
    return lgamma(a) + lgamma(b) - lgamma(np.array(phi)) - (a - 1) * np.log(y) - (b - 1) * np.log1p(-y)


def _expit(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def joint_gradient(p: dict[str, np.ndarray], m: np.ndarray, i: np.ndarray, c: np.ndarray, y: np.ndarray, length: np.ndarray, phi: float = PHI) -> tuple[float, float, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Summed losses and gradients of the two channels over cells; NaN cells are left out of their channel."""
    one, two = ~np.isnan(c), ~np.isnan(y)
    eta = p["a"][i] * (p["theta_A"][m] - p["b"][i])
    s = _expit(eta)
    q = np.clip(s, 1e-12, None), np.clip(1 - s, 1e-12, None)
    loss1 = -np.where(one, np.nan_to_num(c) * np.log(q[0]) + (1 - np.nan_to_num(c)) * np.log(q[1]), 0.0).sum()
    g1 = np.where(one, s - np.nan_to_num(c), 0.0)
    total = p["theta_A"][m] + p["theta_C"][m] + p["z"][i]
    eta2 = p["alpha"][i] * total + p["gamma_m"][m] * length[i]
    raw = _expit(eta2)
    mu = np.clip(raw, CLAMP, 1 - CLAMP)
    yy = np.clip(np.where(two, y, 0.5), CLAMP, 1 - CLAMP)
    loss2 = np.where(two, beta_nll(yy, mu, phi), 0.0).sum()
    slope = phi * (digamma(mu * phi) - digamma((1 - mu) * phi) - np.log(yy) + np.log1p(-yy))
    g2 = np.where(two & (raw > CLAMP) & (raw < 1 - CLAMP), slope * mu * (1 - mu), 0.0)
    n_m, n_i = len(p["theta_A"]), len(p["a"])
    at = lambda k, v, n: np.bincount(k, weights=v, minlength=n)
    first = {"theta_A": at(m, g1 * p["a"][i], n_m), "a": at(i, g1 * (p["theta_A"][m] - p["b"][i]), n_i), "b": at(i, -g1 * p["a"][i], n_i)}
    shared = at(m, g2 * p["alpha"][i], n_m)
    second = {"theta_A": shared, "theta_C": shared, "z": at(i, g2 * p["alpha"][i], n_i), "alpha": at(i, g2 * total, n_i), "gamma_m": at(m, g2 * length[i], n_m)}
    return loss1, loss2, first, second


class AdamW:
    def __init__(self, lr: float, decay: float = 0.01):
        self.lr, self.decay, self.step, self.state = lr, decay, 0, {}

    def update(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            mean, square = self.state.get(k, (np.zeros_like(g), np.zeros_like(g)))
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            self.state[k] = mean, square
            params[k] *= 1 - self.lr * self.decay
            params[k] -= self.lr * (mean / (1 - 0.9**self.step)) / (np.sqrt(square / (1 - 0.999**self.step)) + 1e-8)


MODEL_PARAMS, ITEM_PARAMS = ("theta_A", "theta_C", "gamma_m"), ("a", "b", "alpha", "z")


def start_params(n_models: int, n_items: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {k: rng.standard_normal(n_models) * 0.1 for k in MODEL_PARAMS}
    return out | {k: rng.standard_normal(n_items) * 0.1 + (k in ("a", "alpha")) for k in ITEM_PARAMS}


def fit_joint(cells: DataFrame, epochs: int = 400, lr: float = 0.05, clip: float | None = None, phi: float = PHI, seed: int = 0) -> tuple[pd.DataFrame, pd.DataFrame, list[float]]:
    """Two latent traits per model shared by correctness (logistic) and response (Beta) of its cells.

    ``cells``: ``model_id, item_id, c, y, tok_len`` (null where not observed). Returns the models, the
    items and the loss after every epoch. Blocks are centred after every step.
    """
    models = [r[0] for r in cells.select("model_id").distinct().orderBy("model_id").collect()]
    lengths = cells.groupBy("item_id").agg(F.median("tok_len").alias("t")).orderBy("item_id").collect()
    items = [r["item_id"] for r in lengths]
    t = np.array([np.nan if r["t"] is None else r["t"] for r in lengths], float)
    length = np.nan_to_num(t - np.nanmean(t)) if np.isfinite(t).any() else np.zeros(len(t))
    spark = cells.sparkSession
    at_m = spark.createDataFrame(list(zip(models, range(len(models)))), "model_id string, m int")
    at_i = spark.createDataFrame(list(zip(items, range(len(items)))), "item_id string, i int")
    coded = cells.join(at_m, "model_id").join(at_i, "item_id").select("m", "i", F.col("c").cast("double").alias("c"), F.col("y").cast("double").alias("y")).persist()
    counts = coded.agg(F.count("c").alias("n1"), F.count("y").alias("n2")).first()
    n1, n2 = max(1, counts["n1"]), max(1, counts["n2"])
    params, optimiser, history = start_params(len(models), len(items), seed), AdamW(lr), []
    for _ in range(epochs):
        sent = spark.sparkContext.broadcast((params, length))

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p, lens = sent.value
            total, grads = 0.0, {k: np.zeros_like(v) for k, v in p.items()}
            for f in frames:
                l1, l2, g1, g2 = joint_gradient(p, f["m"].to_numpy(), f["i"].to_numpy(), f["c"].to_numpy(float), f["y"].to_numpy(float), lens, phi)
                total += l1 / n1 + l2 / n2
                for k in grads:
                    grads[k] += g1.get(k, 0) / n1 + g2.get(k, 0) / n2
            rows = [("loss", 0, total), *((k, j, x) for k, g in grads.items() for j, x in zip(np.flatnonzero(g).tolist(), g[g != 0].tolist()))]
            yield pd.DataFrame(rows, columns=["name", "at", "value"])

        got = coded.mapInPandas(part, "name string, at int, value double").groupBy("name", "at").agg(F.sum("value").alias("value")).toPandas()
        sent.destroy()
        grads = {k: np.zeros_like(v) for k, v in params.items()}
        for k, g in got[got["name"] != "loss"].groupby("name"):
            grads[k][g["at"].to_numpy()] = g["value"].to_numpy()
        history.append(float(got.loc[got["name"] == "loss", "value"].sum()))
        if clip is not None:
            norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
            grads = {k: g * min(1.0, clip / (norm + 1e-6)) for k, g in grads.items()}
        optimiser.update(params, grads)
        for k in ("theta_A", "theta_C", "z", "gamma_m"):
            params[k] -= params[k].mean()
    coded.unpersist()
    if not all(np.isfinite(v).all() for v in params.values()):
        raise ValueError("the fit left the finite range")
    return pd.DataFrame({"model_id": models, **{k: params[k] for k in MODEL_PARAMS}}), pd.DataFrame({"item_id": items, **{k: params[k] for k in ITEM_PARAMS}}), history


LADDERS = {
    "acc_conf": ["acc", "conf"],
    "acc_conf_quadratic": ["acc", "conf", "acc*acc", "conf*conf", "acc*conf"],
    "with_length": ["acc", "conf", "acc*acc", "conf*conf", "acc*conf", "tok_len", "tok_len*tok_len", "acc*tok_len", "conf*tok_len"],
}


def ols_residuals(rows: DataFrame, by: list[str], target: str, covariates: list[str], key: list[str]) -> DataFrame:
    """``by, key, r``: residual of ``target`` on standardised covariates, their products and an intercept.

    Rows with a missing value are left out. Moments are one aggregate; the equations are solved on the driver.
    """
    names = sorted({p for c in covariates for p in c.split("*")})
    whole = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [target, *names]))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    whole = whole.select(*by, *key, F.col(target).alias("_y"), *[((F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-12)).alias(c) for c in names])
    terms = [F.lit(1.0), *[_product(c) for c in covariates]]
    k = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(terms[i] * F.col("_y")).alias(f"y{i}") for i in range(k)]
    fits = []
    for r in whole.groupBy(*by).agg(*sums).collect():  # one row per fit
        x = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        beta, *_ = np.linalg.lstsq(x, np.array([r[f"y{i}"] for i in range(k)]), rcond=None)
        fits.append((*[r[c] for c in by], [float(b) for b in beta]))
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)
    coef = F.broadcast(rows.sparkSession.createDataFrame(fits, f"{kinds}_beta array<double>"))
    joined = whole.join(coef, by) if by else whole.crossJoin(coef)  # one fit
    fitted = sum((t * F.col("_beta")[i] for i, t in enumerate(terms[1:], 1)), F.col("_beta")[0])
    return joined.select(*by, *key, (F.col("_y") - fitted).alias("r"))


def _product(name: str):
    first, *rest = name.split("*")
    out = F.col(first)
    for c in rest:
        out = out * F.col(c)
    return out


def ladder(a: DataFrame, b: DataFrame, target: str, ladders: dict[str, list[str]] = LADDERS) -> DataFrame:
    """``rung, corr, share_a, share_b, n_pairs``: correlation of the residuals of two benchmarks, and what is left of the variance."""
    out = None
    for name, covariates in ladders.items():
        ra, rb = (ols_residuals(x, [], target, covariates, ["model_id"]) for x in (a, b))
        share = lambda r, x: r.agg(F.var_pop("r").alias("v")).crossJoin(x.agg(F.var_pop(target).alias("t"))).select((F.col("v") / (F.col("t") + 1e-12)).alias("s"))
        both = ra.withColumnRenamed("r", "ra").join(rb.withColumnRenamed("r", "rb"), "model_id").agg(guarded_corr("ra", "rb", 6).alias("corr"), F.count("*").alias("n_pairs"))
        row = both.crossJoin(share(ra, a).withColumnRenamed("s", "share_a")).crossJoin(share(rb, b).withColumnRenamed("s", "share_b"))  # single rows
        row = row.select(F.lit(name).alias("rung"), "corr", "share_a", "share_b", "n_pairs")
        out = row if out is None else out.unionByName(row)
    return out


def align_sign(rows: DataFrame, value: str, anchor: str) -> DataFrame:
    """``value`` with the sign that makes it rise with ``anchor``."""
    sign = rows.agg(F.when(guarded_corr(value, anchor, 6) < 0, -1.0).otherwise(1.0).alias("_sign"))
    return rows.crossJoin(F.broadcast(sign)).withColumn(value, F.col(value) * F.col("_sign")).drop("_sign")  # one row on the right


GAUGES = [("identity", 0.0, 1.0), ("shift_up", 0.5, 1.0), ("shift_down", -0.5, 1.0), ("stretch", 0.0, 2.0), ("shift_and_shrink", 0.3, 0.5)]


def gauge_check(cells: DataFrame, models: DataFrame, items: DataFrame, scenarios: list[tuple[str, float, float]] = GAUGES) -> DataFrame:
    """``scenario, max_diff``: how much the correctness logits move when traits shift by t and stretch by s, with items to match."""
    table = cells.sparkSession.createDataFrame(scenarios, "scenario string, t double, s double")
    rows = cells.select("model_id", "item_id").join(models.select("model_id", "theta_A"), "model_id").join(items.select("item_id", "a", "b"), "item_id").crossJoin(F.broadcast(table))  # a fixed handful of scenarios
    theta, b = F.col("s") * F.col("theta_A") + F.col("t"), F.col("s") * F.col("b") + F.col("t")
    moved = F.col("a") / F.col("s") * (theta - b) - F.col("a") * (F.col("theta_A") - F.col("b"))
    return rows.groupBy("scenario").agg(F.max(F.abs(moved)).alias("max_diff"))


def transfer(models: DataFrame, items: DataFrame, steps: int = 64, reach: float = 60.0) -> DataFrame:
    """``model_id, theta``: the trait at which the mean logistic accuracy over the items equals the model's accuracy.

    Bisection over all models at once: each step is one pass of the model x item grid, with the items as
    an array on every model, as they are one benchmark's.
    """
    pack = items.agg(F.sort_array(F.collect_list("b")).alias("bs"))
    rows = models.select("model_id", "s", "acc").crossJoin(F.broadcast(pack))  # one row on the right

    def halve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            low, high = np.full(len(f), -reach), np.full(len(f), reach)
            s, acc = f["s"].to_numpy(float)[:, None], f["acc"].to_numpy(float)
            bs = np.array(f["bs"].tolist(), float).reshape(len(f), -1)
            for _ in range(steps):
                mid = (low + high) / 2
                under = _expit(s * (mid[:, None] - bs)).mean(axis=1) < acc
                low, high = np.where(under, mid, low), np.where(under, high, mid)
            yield pd.DataFrame({"model_id": f["model_id"], "theta": (low + high) / 2})

    return rows.mapInPandas(halve, "model_id string, theta double")
