"""Grouped bootstrap, simultaneous intervals, jackknife and permutation nulls.

Random indices come from the same NumPy generator and seed as the published analysis. They are a
table of (draw, position, group) made on the driver, whose size is draws x groups whatever the number
of rows; all the rest are joins and grouped means.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 20260914
LEAST_PAIRS, LEAST_VAR = 6, 1e-24  # of a permuted correlation


def draw_table(spark: SparkSession, n_groups: int, n_boot: int = 2000, seed: int = SEED) -> DataFrame:
    """``draw, g, times``: how often each draw holds each group."""
    ix = np.random.default_rng(seed).integers(0, n_groups, size=(n_boot, n_groups))
    times = np.stack([np.bincount(row, minlength=n_groups) for row in ix])
    draw, g = np.nonzero(times)
    return spark.createDataFrame(pd.DataFrame({"draw": draw, "g": g, "times": times[draw, g]}), "draw long, g long, times long")


def group_losses(preds: DataFrame, by: list[str]) -> DataFrame:
    return preds.groupBy(*by, "org_id").agg(F.avg(F.pow(F.col("truth") - F.col("pred"), 2)).alias("loss"))


def loss_differences(losses: DataFrame, by: list[str], baseline: str = "base") -> DataFrame:
    """``by, package, org_id, d, base``: what each package saves against the baseline in each organisation."""
    keys = [*by, "org_id"]
    base = losses.where(F.col("package") == baseline).select(*keys, F.col("loss").alias("base"))
    return losses.where(F.col("package") != baseline).join(base, keys).select(*keys, "package", (F.col("base") - F.col("loss")).alias("d"), "base")


def _numbered(rows: DataFrame, group: str = "org_id") -> DataFrame:
    """Groups numbered in lexicographic order."""
    ids = rows.select(group).distinct()
    return rows.join(ids.withColumn("g", F.row_number().over(Window.orderBy(group)) - 1), group)


def bootstrap_means(rows: DataFrame, by: list[str], value: str, n_boot: int = 2000, seed: int = SEED, group: str = "org_id") -> DataFrame:
    """``by, draw, m``: mean of ``value`` (one row per group) in every draw of groups."""
    numbered = _numbered(rows, group)
    n = rows.select(group).distinct().count()
    draws = draw_table(rows.sparkSession, n, n_boot, seed)
    return numbered.join(draws, "g").groupBy(*by, "draw").agg((F.sum(F.col(value) * F.col("times")) / n).alias("m"))


def simultaneous(diffs: DataFrame, column: list[str], fold_delta: DataFrame, n_boot: int = 2000, seed: int = SEED) -> DataFrame:
    """Max-t simultaneous intervals and support of each column of differences.

    ``diffs``: ``column.., org_id, d, base``; ``fold_delta``: ``column.., outer, delta``. A column that is
    zero throughout gets [0, 0]; one without variance otherwise is inconclusive.
    """
    g = F.count("*")
    stats = diffs.groupBy(*column).agg(
        F.avg("d").alias("delta"), F.avg("base").alias("baseline_loss"), F.sqrt(F.var_pop("d") / (g - 1)).alias("se"), (F.max(F.abs("d")) == 0).alias("zero"),
    )
    stats = stats.withColumn("calc", (F.col("se") > 1e-12) & (F.col("baseline_loss") > 1e-12))
    boot = bootstrap_means(diffs, column, "d", n_boot, seed).join(F.broadcast(stats.where("calc").select(*column, "delta", "se")), column)
    t = boot.groupBy("draw").agg(F.max(F.abs(F.col("m") - F.col("delta")) / F.col("se")).alias("t"))
    crit = t.agg(F.percentile("t", 0.95).alias("crit"))
    folds = fold_delta.groupBy(*column).agg(F.count_if(F.col("delta") > 0).alias("positive_folds"))
    out = stats.join(folds, column).crossJoin(F.broadcast(crit))  # one row on the right
    small = F.col("baseline_loss") <= 1e-12
    gain = F.col("delta") / F.when(~small, F.col("baseline_loss"))
    low = F.when(F.col("zero"), 0.0).when(F.col("calc"), F.col("delta") - F.col("crit") * F.col("se"))
    high = F.when(F.col("zero"), 0.0).when(F.col("calc"), F.col("delta") + F.col("crit") * F.col("se"))
    flat = ~F.col("calc") & ~F.col("zero")
    return out.select(
        *column, "delta", "baseline_loss", "se", F.when(~small & ~flat, gain).alias("relative_improvement"), F.when(~small, low).alias("low"), F.when(~small, high).alias("high"), "positive_folds",
        support(gain, low, F.col("positive_folds"), small, flat).alias("status"),
        F.when(small, "BASELINE_LOSS_LE1E12").when(flat, "DEGENERATE_VARIANCE").otherwise("").alias("reason"),
    )


def support(gain: Column, low: Column, positive_folds: Column, small: Column, flat: Column) -> Column:
    wins = (gain >= 0.05) & (low > 0) & (positive_folds >= 4)
    return F.when(small | flat, "INCONCLUSIVE").when(wins, "EXPLORATORY_CANDIDATE").otherwise("NO_PREDEFINED_INCREMENT")


def percentile_interval(boot: DataFrame, by: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    q = F.percentile("m", F.array(F.lit(low), F.lit(high)))
    return boot.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def verdict(cal: Column, sel: Column) -> Column:
    """Joint reading of the two endpoints' support."""
    inc = (cal == "INCONCLUSIVE") | (sel == "INCONCLUSIVE")
    a, b = cal == "EXPLORATORY_CANDIDATE", sel == "EXPLORATORY_CANDIDATE"
    return F.when(inc, "INCONCLUSIVE").when(a & b, "JOINT_SUPPORT").when(a, "CAL_ONLY").when(b, "SELECT_ONLY").otherwise("NO_DEMONSTRATED_GAIN")


def jackknife_corr(rows: DataFrame, families: DataFrame, x: str, y: str, least: int = 10) -> DataFrame:
    """Delete-one-family jackknife of a correlation, from per-family sums: no row is copied per deletion.

    ``families``: the ``family`` values to delete in turn; rows of other families stay in every round.
    """
    a, b = F.col(x), F.col(y)
    sums = {"n": F.lit(1.0), "sx": a, "sy": b, "sxx": a * a, "syy": b * b, "sxy": a * b}
    whole = rows.where(a.isNotNull() & b.isNotNull())
    per = whole.groupBy("family").agg(*[F.sum(e).alias(k) for k, e in sums.items()])
    total = per.agg(*[F.sum(k).alias(f"t_{k}") for k in sums])
    left = per.join(families.select("family").distinct(), "family").crossJoin(F.broadcast(total))  # one row on the right
    r = lambda f: (f("n") * f("sxy") - f("sx") * f("sy")) / F.sqrt(_positive(f("n") * f("sxx") - f("sx") * f("sx")) * _positive(f("n") * f("syy") - f("sy") * f("sy")))
    without = left.select("family", (F.col("t_n") - F.col("n")).alias("kept"), r(lambda k: F.col(f"t_{k}") - F.col(k)).alias("v")).where(F.col("kept") >= least)
    point = total.select(r(lambda k: F.col(f"t_{k}")).alias("point"))
    out = without.where("v IS NOT NULL").agg(F.count("*").alias("n_families"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.var_pop("v").alias("var"))
    out = out.crossJoin(F.broadcast(point)).withColumn("se", F.sqrt((F.col("n_families") - 1) * F.col("var")))
    return out.select("point", "mean", "min", "max", "se", (F.col("point") - 1.96 * F.col("se")).alias("low"), (F.col("point") + 1.96 * F.col("se")).alias("high"), "n_families")


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def cluster_r2(rows: DataFrame, truth: str, pred: str, n_boot: int = 1000, seed: int = SEED, group: str = "org_id") -> DataFrame:
    """``draw, r2`` over organisations drawn with replacement, from each organisation's sums."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(truth).alias("sy"), F.sum(F.col(truth) * F.col(truth)).alias("syy"), F.sum(F.pow(F.col(truth) - F.col(pred), 2)).alias("srr"))
    numbered = _numbered(per, group)
    draws = draw_table(rows.sparkSession, per.count(), n_boot, seed)
    s = numbered.join(draws, "g").groupBy("draw").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("n", "sy", "syy", "srr")])
    var = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return s.select("draw", (1 - F.col("srr") / F.when(var > 0, var)).alias("r2"))


def selection_study(cand: DataFrame, preds: DataFrame, by: list[str]) -> DataFrame:
    """``by, org_id, chosen, oracle, regret``: true risk of the candidate with the lowest prediction, against the best.

    ``cand``: ``model_id, org_id``; ``preds``: ``by.., model_id, org_id, truth, pred``; ties by model.
    """
    rows = preds.join(cand.select("model_id", "org_id"), ["model_id", "org_id"])
    out = rows.groupBy(*by, "org_id").agg(F.min_by("truth", F.struct("pred", "model_id")).alias("chosen"), F.min("truth").alias("oracle"))
    return out.withColumn("regret", F.col("chosen") - F.col("oracle"))


def permutation_null(pairs: DataFrame, x: str, y: str, order: str, n_perm: int = 200, seed: int = 0) -> DataFrame:
    """``perm, r``: correlation of x with shuffled y; the permutations follow one generator in row order.

    Permutations are drawn inside tasks from the generator's states before each block, so the driver keeps no
    more than one of them. A permutation of one generator is one array of all rows wherever it is drawn; the
    values travel beside it as one pair of arrays, so this is for per-model tables, as in the analysis.
    """
    from tessella.operators.ladders import stream_states

    rows = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(order, F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b"))
    n = rows.count()
    sorted_rows = rows.agg(F.sort_array(F.collect_list(F.struct(order, "a", "b"))).alias("p"))
    arrays = sorted_rows.select(F.lit("all").alias("rung"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    states = pairs.sparkSession.createDataFrame(stream_states(n, [["all"]], n_perm if n else 0, seed), "rung string, first int, last int, key binary, pos int")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in f.itertuples(index=False):
                rng = np.random.RandomState()
                rng.set_state(("MT19937", np.frombuffer(s.key, "<u4"), s.pos))
                a, b = np.asarray(s.a, float), np.asarray(s.b, float)
                a, b = a - a.mean(), b - b.mean()
                va, vb = (a @ a) / n, (b @ b) / n
                ok = n >= LEAST_PAIRS and va > LEAST_VAR and vb > LEAST_VAR
                moved = [float(a @ b[rng.permutation(n)]) / n for _ in range(s.first, s.last)]
                yield pd.DataFrame({"perm": range(s.first, s.last), "r": [m / np.sqrt(va * vb) if ok else None for m in moved]})

    spread = states.repartition(max(1, n_perm // 25), "first")
    return spread.join(F.broadcast(arrays), "rung").mapInPandas(draw, "perm long, r double")  # one row on the right


def risk_bounds(e: Column, n: Column, k: Column) -> tuple[Column, Column]:
    """Least and greatest selective risk at coverage k of n items with e errors."""
    return F.greatest(F.lit(0), e - (n - k)) / k, F.least(e, k) / k
