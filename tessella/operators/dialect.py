"""The slope analysis' own bilinear fit: every item kept, denominators clamped, two starts, and how far these agree.

``ell`` of a model is a line in the item positions, ell = a - s b. Lines and positions alternate; positions are
standardised over the items after each round, without carrying the scale over into the lines. Unlike
``structure.als_reference`` no fit fails: flat denominators are clamped at ``FLOOR``. Missing ``ell`` must be left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.stats import guarded_corr
from tessella.operators.structure import checkpointed

# Fixed values of the analysis.
FLOOR = 1e-12
CLIP = 1e-4
FEW_ITEMS = 50
LOW_VARIANCE = 1e-6


def _standard(rows: DataFrame, value: str) -> DataFrame:
    """``init, item_id, b``: mean 0 and variance 1 over the items of a start; only centred where they do not vary."""
    size = rows.groupBy("init").agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    scaled = rows.join(F.broadcast(size), "init")  # a row per start
    return scaled.select("init", "item_id", ((F.col(value) - F.col("_mu")) / F.when(F.col("_sd") < FLOOR, 1.0).otherwise(F.col("_sd"))).alias("b"))


def starts(obs: DataFrame) -> DataFrame:
    """``init, item_id, b``: ``primary`` from the mean of ell, ``binary`` from the logit of the share of ell > 0, clipped."""
    g = obs.groupBy("item_id").agg(F.avg("ell").alias("m"), F.avg((F.col("ell") > 0).cast("double")).alias("p"))
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("p")))
    both = F.array(F.struct(F.lit("primary").alias("init"), (-F.col("m")).alias("v")), F.struct(F.lit("binary").alias("init"), F.log((1 - p) / p).alias("v")))
    return _standard(g.select("item_id", F.explode(both).alias("_s")).select("item_id", "_s.*"), "v")


def _whole_models(cells: DataFrame, place: dict[str, int]) -> DataFrame:
    """``model_id`` and its cells as arrays: number of the item and ell."""
    names = cells.sparkSession.createDataFrame(list(place.items()), "item_id string, i int")
    rows = cells.join(F.broadcast(names), "item_id")  # a row per item of the benchmark
    lists = rows.groupBy("model_id").agg(F.collect_list(F.struct("i", "ell")).alias("_r"))
    return checkpointed(lists.select("model_id", F.col("_r.i").alias("i"), F.col("_r.ell").alias("ell")))


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    at, i, ell = batch.column("i").offsets.to_numpy(), batch.column("i").values.to_numpy(), batch.column("ell").values.to_numpy()
    for k, model in enumerate(batch.column("model_id").to_pylist()):
        yield model, i[at[k] : at[k + 1]], ell[at[k] : at[k + 1]]


def _line(b: np.ndarray, ell: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """``a, s`` of each start (rows of ``b``) and mean and variance of ell, over the cells of one model."""
    mean, mb = float(ell.mean()), b.mean(1)
    de, db = ell - mean, b - mb[:, None]
    s = -(db @ de) / len(ell) / np.maximum((db * db).mean(1), FLOOR)
    return mean + s * mb, s, mean, float((de * de).mean())


def _round(models: DataFrame, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of s (a - ell) and s s for each start and item, from lines of whole models: a row per task and start."""
    sent = models.sparkSession.sparkContext.broadcast(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        num, den = np.zeros_like(b), np.zeros_like(b)
        for batch in batches:
            for _, i, ell in _arrays(batch):
                a, s, _, _ = _line(b[:, i], ell)
                for k in range(len(b)):  # an item may come more than once
                    num[k] += np.bincount(i, s[k] * (a[k] - ell), b.shape[1])
                    den[k] += np.bincount(i, minlength=b.shape[1]) * (s[k] * s[k])
        flat = lambda v: pa.array(list(v), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(b)), pa.int32()), flat(num), flat(den)], ["k", "num", "den"])

    parts = models.mapInArrow(run, "k int, num array<double>, den array<double>").select("k", F.posexplode(F.arrays_zip("num", "den")).alias("i", "_p"))
    sums = parts.groupBy("k", "i").agg(F.sum("_p.num").alias("num"), F.sum("_p.den").alias("den")).toPandas()  # starts x items of the benchmark
    sent.unpersist()
    num, den = np.zeros_like(b), np.zeros_like(b)
    num[sums["k"], sums["i"]], den[sums["k"], sums["i"]] = sums["num"], sums["den"]
    return num, den


def _fitted(models: DataFrame, b: np.ndarray, names: list[str]) -> DataFrame:
    """``init, model_id, n, a, s, mean_ell, var_ell, sigma, acc`` on given positions."""
    sent = models.sparkSession.sparkContext.broadcast(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for model, i, ell in _arrays(batch):
                at = sent.value[:, i]
                a, s, mean, var = _line(at, ell)
                sigma = (ell - (a[:, None] - s[:, None] * at)).std(1)
                acc = float((ell > 0).mean())
                rows += [(name, model, len(ell), a[k], s[k], mean, var, sigma[k], acc) for k, name in enumerate(names)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] * 2 + [pa.int64()] + [pa.float64()] * 6)], ["init", "model_id", "n", "a", "s", "mean_ell", "var_ell", "sigma", "acc"])

    return models.mapInArrow(run, "init string, model_id string, n long, a double, s double, mean_ell double, var_ell double, sigma double, acc double")


def fit(obs: DataFrame, max_iter: int = 500, tol: float = 1e-6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``items (init, item_id, b)``, ``models (init, model_id, n, a, s, theta, sigma, mean_ell, var_ell, acc)`` and ``status (init,
    n_iter, moved, converged)`` from both starts; a start stops once no position moves by ``tol``. ``theta`` is null where s is 0.

    Both starts go through the rounds together. A round is one pass over whole models inside tasks; the driver holds the
    positions (starts x items of the benchmark) and sends them.
    """
    spark = obs.sparkSession
    cells = checkpointed(obs.where("ell IS NOT NULL").select("model_id", "item_id", "ell"))
    first = starts(cells).toPandas()  # starts x items of the benchmark
    names, keys = sorted(set(first["init"])), sorted(set(first["item_id"]))
    place = {k: n for n, k in enumerate(keys)}
    b = np.zeros((len(names), len(keys)))
    b[first["init"].map(names.index).to_numpy(int), first["item_id"].map(place).to_numpy(int)] = first["b"]
    models = _whole_models(cells, place)
    done: dict[str, tuple[int, float, bool]] = {}
    moved: dict[str, float] = {}
    for step in range(1, max_iter + 1 if names else 1):
        num, den = _round(models, b)
        raw = num / np.maximum(den, FLOOR)
        sd = raw.std(1)
        new = (raw - raw.mean(1)[:, None]) / np.where(sd < FLOOR, 1.0, sd)[:, None]
        settled = np.array([k in done for k in names])
        new[settled] = b[settled]
        moved = {k: float(d) for k, d in zip(names, np.abs(new - b).max(1))}
        b = new
        done |= {k: (step, d, True) for k, d in moved.items() if k not in done and d < tol}
        if len(done) == len(moved):
            break
    done |= {k: (max_iter, d, False) for k, d in moved.items() if k not in done}
    items = spark.createDataFrame([(n, k, float(b[j, i])) for j, n in enumerate(names) for i, k in enumerate(keys)], "init string, item_id string, b double")
    found = _fitted(models, b, names).withColumn("theta", F.col("a") / F.when(F.col("s") != 0, F.col("s")))
    status = spark.createDataFrame([(k, *v) for k, v in done.items()], "init string, n_iter int, moved double, converged boolean")
    return items, checkpointed(found), status


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def flagged(models: DataFrame) -> DataFrame:
    """``models`` with ``flags`` joined by '|' and ``fittable``; a negative slope is flagged but can be fitted."""
    bad = {"few_items": F.col("n") < FEW_ITEMS, "degenerate_lowvar": F.col("var_ell") < LOW_VARIANCE, "nonfinite": ~(_finite("s") & _finite("theta"))}
    names = [F.when(c, F.lit(k)) for k, c in bad.items()] + [F.when(_finite("s") & (F.col("s") <= 0), F.lit("neg_slope"))]
    return models.withColumn("flags", F.concat_ws("|", *names)).withColumn("fittable", ~F.greatest(*bad.values()))


def agreement(items: DataFrame, models: DataFrame) -> DataFrame:
    """One row: correlations and greatest differences of s, theta and b between the starts, the second's sign turned if its s runs against the first's."""
    ok = flagged(models).where("fittable")
    side = lambda df, k, cols, init, e: df.where(F.col("init") == init).select(k, *[F.col(c).alias(f"{c}{e}") for c in cols])
    pair = side(ok, "model_id", ["s", "theta"], "primary", 1).join(side(ok, "model_id", ["s", "theta"], "binary", 2), "model_id")
    place = side(items, "item_id", ["b"], "primary", 1).join(side(items, "item_id", ["b"], "binary", 2), "item_id")
    sign = pair.agg(F.coalesce(guarded_corr("s1", "s2") < 0, F.lit(False)).alias("flipped"))
    t = F.when(F.col("flipped"), -1.0).otherwise(1.0)
    gap = lambda c: F.max(F.abs(F.col(f"{c}1") - t * F.col(f"{c}2"))).alias(f"max_{c}")
    corr = lambda c: guarded_corr(F.col(f"{c}1"), t * F.col(f"{c}2")).alias(f"r_{c}")
    one = pair.crossJoin(F.broadcast(sign)).agg(F.count("*").alias("n_agree"), corr("s"), corr("theta"), gap("s"), gap("theta"))  # single row on the right
    two = place.crossJoin(F.broadcast(sign)).agg(corr("b"), gap("b"))
    return sign.crossJoin(one).crossJoin(two)  # single rows
