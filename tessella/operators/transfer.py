"""Transfer of a model's slope and trait from one benchmark to another, held out by organisation.

Organisations fall into two folds. What a fold is scored with on the target benchmark (item positions,
the scale that slopes take there, the median slope) comes from the other fold alone. A model's slope is
carried over in three ways: times that scale, as the median times that scale, and as it is. From each
follow its accuracy at the source's trait, and, at the trait that gives the accuracy observed, its
confidence by logistic quadrature and so its overconfidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import structure
from tessella.operators.inference import SEED, _numbered, draw_table

NODES = 64
STEPS, REACH = 64, 60.0
VARIANTS = ["rescale", "median", "literal"]


def logistic_nodes(n: int = NODES) -> np.ndarray:
    """Midpoint quantiles of the standard logistic distribution."""
    u = (np.arange(n) + 0.5) / n
    return np.log(u / (1 - u))


def two_folds(orgs: DataFrame, seed: int = SEED) -> DataFrame:
    """``org_id, fold``: organisations in lexicographic order, dealt in turn after one shuffle of the published generator."""
    numbered = _numbered(orgs.select("org_id").distinct())
    n = numbered.count()
    order = np.random.default_rng(seed).permutation(n)
    dealt = orgs.sparkSession.createDataFrame([(int(g), k % 2) for k, g in enumerate(order)], "g long, fold int")  # organisations
    return numbered.join(F.broadcast(dealt), "g").select("org_id", "fold")


def theory_scores(obs: DataFrame) -> DataFrame:
    """``model_id, acc, over``: share of positive log odds, and mean confidence in the likelier side less that share."""
    own = F.avg((F.col("ell") > 0).cast("double"))
    return obs.groupBy("model_id").agg(own.alias("acc"), (F.avg(1 / (1 + F.exp(-F.abs("ell")))) - own).alias("over"))


def frozen(source: DataFrame, lines: DataFrame) -> DataFrame:
    """``fold, c, med``: scale and median slope for the models scored in a fold, from those of the other one.

    ``source``: ``model_id, fold, s``; ``lines``: ``model_id, s`` fitted on the target by each model's own fold.
    """
    both = source.join(lines.select("model_id", F.col("s").alias("s_target")), "model_id", "left")
    good = (F.col("s") > 0) & (F.col("s_target") > 0)
    ratio = F.when(good, F.log(F.when(good, F.col("s_target"))) - F.log(F.when(good, F.col("s"))))
    return both.groupBy((1 - F.col("fold")).alias("fold")).agg(F.exp(F.avg(ratio)).alias("c"), F.median(F.when(F.col("s") > 0, F.col("s"))).alias("med"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def invert(acc: np.ndarray, s: np.ndarray, b: np.ndarray, steps: int = STEPS, reach: float = REACH) -> np.ndarray:
    """The trait at which the mean accuracy over the items equals ``acc``, by bisection of all rows at once.

    exp(-s (t - b)) is exp(s b) exp(-s t), so that a step needs one exponential a row; rows where these may overflow take them in one.
    """
    low, high = np.full(len(acc), -reach), np.full(len(acc), reach)
    with np.errstate(invalid="ignore"):
        apart = np.abs(s) * (reach + np.abs(b).max(initial=0.0)) < 600
    buffer, grown = np.empty((int(apart.sum()), len(b))), np.exp(s[apart, None] * b)
    for _ in range(steps):
        mid = (low + high) / 2
        mean = np.empty(len(acc))
        np.multiply(grown, np.exp(-s[apart] * mid[apart])[:, None], out=buffer)
        np.reciprocal(np.add(buffer, 1.0, out=buffer), out=buffer)
        mean[apart] = buffer.mean(1)
        mean[~apart] = _sigmoid(s[~apart, None] * (mid[~apart, None] - b)).mean(1)
        under = mean < acc
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def confidence(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Mean over items and nodes of the likelier side's probability at ``x`` (rows x items) plus each node.

    With g = exp(x + node) it is max(1, g) / (1 + g), so that nodes need no exponential of their own; beyond 300 it is 1.
    """
    grown, total = np.exp(np.clip(x, -300, 300)), np.zeros(len(x))
    g, top = np.empty_like(grown), np.empty_like(grown)
    for e in np.exp(nodes):
        np.multiply(grown, e, out=g)
        np.maximum(g, 1.0, out=top)
        total += np.divide(top, np.add(g, 1.0, out=g), out=top).mean(1)
    return total / len(nodes)


def predicted(rows: DataFrame, positions: DataFrame, chunk: int = 100) -> DataFrame:
    """``model_id, fold, variant, pred_acc, pred_over`` for rows ``model_id, fold, theta, acc, s_rescale, s_median, s_literal``.

    ``positions``: ``fold, item_id, b`` for the models scored in a fold; the items of one benchmark travel as
    an array on each row. A row with a null input gets nulls.
    """
    pack = positions.where("b IS NOT NULL").groupBy("fold").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism  # rows are few bytes and much work: a plain shuffle would put them into few tasks
    spread = rows.select("model_id", "fold", "theta", "acc", *(f"s_{v}" for v in VARIANTS)).repartition(parts, "model_id")
    joined = spread.join(F.broadcast(pack), "fold")  # two rows
    nodes = logistic_nodes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pandas()
            for _, part in t.groupby("fold", sort=True):
                b = np.asarray(part["bs"].iloc[0], float)
                for at in range(0, len(part), chunk):
                    some = part.iloc[at : at + chunk]
                    theta, acc = (some[c].to_numpy(float) for c in ("theta", "acc"))
                    for v in VARIANTS:
                        s = some[f"s_{v}"].to_numpy(float)
                        forward = _sigmoid(s[:, None] * (theta[:, None] - b)).mean(1)
                        there = np.where(np.isnan(acc) | np.isnan(s), np.nan, invert(acc, s, b))
                        x = s[:, None] * (there[:, None] - b)
                        sure = confidence(x, nodes)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some["model_id"].tolist(), pa.string()), pa.array(some["fold"].tolist(), pa.int32()), pa.array([v] * len(some)), pa.array(forward, from_pandas=True), pa.array(sure - acc, from_pandas=True)],
                            ["model_id", "fold", "variant", "pred_acc", "pred_over"],
                        )

    return joined.mapInArrow(run, "model_id string, fold int, variant string, pred_acc double, pred_over double")


def target_fits(obs: DataFrame, fold_of: DataFrame, fitted: bool = True, **limits) -> tuple[DataFrame, DataFrame]:
    """Positions ``fold, item_id, b`` and lines ``model_id, fold, s`` of each fold's models on the target benchmark.

    ``fitted`` alternates to convergence; else lines are those on start positions.
    """
    rows = structure.checkpointed(obs.join(F.broadcast(fold_of), "org_id").select("fold", "model_id", "item_id", "ell"))  # a row per organisation
    if fitted:
        b, models, _ = structure.als_reference(rows, ["fold"], **limits)
        return b, models.select("model_id", "fold", "s")
    b = structure.checkpointed(structure.initial_positions(rows, ["fold"], limits.get("least_models", 20)).where("b IS NOT NULL"))
    return b, structure.line_fit(rows.join(F.broadcast(b), ["fold", "item_id"]), ["fold", "model_id"]).select("model_id", "fold", "s")  # folds x items


def transfer(source: DataFrame, target: DataFrame, seed: int = SEED, fitted: bool = True, **limits) -> DataFrame:
    """``model_id, org_id, fold, variant, acc, over, pred_acc, pred_over``.

    ``source``: ``model_id, org_id, theta, s`` from the source benchmark; ``target``: observations ``model_id,
    org_id, item_id, ell``. Models with a positive slope and any target observation take part; each is scored
    once, with what the other fold gave. Without usable models in the other fold predictions are null.
    """
    scores = theory_scores(target)
    taking = structure.checkpointed(source.where("s > 0 AND theta IS NOT NULL").select("model_id", "org_id", "theta", "s").join(scores, "model_id"))
    fold_of = structure.checkpointed(two_folds(taking, seed))
    taking = taking.join(F.broadcast(fold_of), "org_id")  # a row per organisation
    estimated = target.join(taking.select("model_id"), "model_id", "left_semi")
    b, lines = target_fits(estimated, fold_of, fitted, **limits)
    scale = frozen(taking, lines)
    there = b.select((1 - F.col("fold")).alias("fold"), "item_id", "b")
    rows = taking.join(F.broadcast(scale), "fold")  # two rows
    rows = rows.select("model_id", "fold", "theta", "acc", (F.col("c") * F.col("s")).alias("s_rescale"), (F.col("c") * F.col("med")).alias("s_median"), F.col("s").alias("s_literal"))
    return taking.select("model_id", "org_id", "acc", "over").join(predicted(rows, there), "model_id").select("model_id", "org_id", "fold", "variant", "acc", "over", "pred_acc", "pred_over")


def r2(preds: DataFrame, by: list[str]) -> DataFrame:
    """``by, r2_acc, r2_over, n``: pooled share of variance; null without variance."""
    whole = preds.where("pred_acc IS NOT NULL AND pred_over IS NOT NULL")
    part = lambda y, p: 1 - F.avg(F.pow(F.col(y) - F.col(p), 2)) / F.when(F.var_pop(y) > 0, F.var_pop(y))
    return whole.groupBy(*by).agg(part("acc", "pred_acc").alias("r2_acc"), part("over", "pred_over").alias("r2_over"), F.count("*").alias("n"))


def r2_intervals(preds: DataFrame, n_boot: int = 1000, seed: int = SEED) -> DataFrame:
    """``measure, low, high``: percentile intervals over organisations drawn with replacement, of R2 and of what the models' own slopes add.

    Only sums per organisation meet the draws.
    """
    y = {"acc": "pred_acc", "over": "pred_over"}
    sums = [F.count("*").alias("n")]
    for t, p in y.items():
        sums += [F.sum(t).alias(f"y_{t}"), F.sum(F.col(t) * F.col(t)).alias(f"yy_{t}"), F.sum(F.pow(F.col(t) - F.col(p), 2)).alias(f"rr_{t}")]
    per = structure.checkpointed(preds.where("pred_acc IS NOT NULL AND pred_over IS NOT NULL").groupBy("variant", "org_id").agg(*sums))
    names = [c for c in per.columns if c not in ("variant", "org_id")]
    draws = draw_table(preds.sparkSession, per.select("org_id").distinct().count(), n_boot, seed)
    drawn = _numbered(per).join(draws, "g").groupBy("variant", "draw").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in names])
    fit = lambda t: 1 - F.col(f"rr_{t}") / F.when(F.col(f"yy_{t}") - F.col(f"y_{t}") * F.col(f"y_{t}") / F.col("n") > 0, F.col(f"yy_{t}") - F.col(f"y_{t}") * F.col(f"y_{t}") / F.col("n"))
    wide = drawn.select("draw", "variant", fit("acc").alias("acc"), fit("over").alias("over")).groupBy("draw").pivot("variant", VARIANTS).agg(F.first("acc").alias("acc"), F.first("over").alias("over"))
    told = [F.struct(F.lit(f"r2_{t}_{v}").alias("measure"), F.col(f"{v}_{t}").alias("m")) for t in y for v in VARIANTS]
    told += [F.struct(F.lit(f"gain_{t}").alias("measure"), (F.col(f"rescale_{t}") - F.col(f"median_{t}")).alias("m")) for t in y]
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return wide.select(F.explode(F.array(*told)).alias("x")).select("x.*").groupBy("measure").agg(q.alias("q")).select("measure", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
