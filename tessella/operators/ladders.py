"""Ladders of covariates for the response trait of two benchmarks: what is left, how it correlates, and against what null.

Tables of traits have a row per benchmark and model: ``bench, model_id`` and the columns of ``TRAITS``, null where
missing. Covariates are z-scored per benchmark over the values that are there; a row lacking a value of a rung has no
residual on it. Least squares runs on triangular factors: each task reduces its rows to one small factor per rung, the
factors are stacked and reduced again, so nothing larger than a factor meets and the precision is that of a dense solver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import guarded_corr
from tessella.operators.structure import checkpointed

TRAITS = ["theta_a", "theta_c", "acc", "resp", "conf", "gauge", "tok_len", "signed"]
LEAST_PAIRS = 6
LEAST_SHARE = 1e-9  # a residual below this share of the variance is rounding, and has no correlation
TINY = 1e-12

# The eight sets of covariates, '*' a product of z-scores, and the stream that a rung's permutations come from.
RUNGS: dict[str, list[str]] = {
    "1_acc_resp": ["acc", "resp"],
    "2_acc_resp_quadratic": ["acc", "resp", "acc*acc", "resp*resp", "acc*resp"],
    "3_trait_resp": ["theta_a", "resp"],
    "4_trait_resp_gauge": ["theta_a", "resp", "gauge"],
    "5_trait_resp_gauge_length": ["theta_a", "resp", "gauge", "tok_len", "tok_len*tok_len"],
    "6_trait_resp_gauge_length_quadratic": ["theta_a", "resp", "gauge", "tok_len", "theta_a*theta_a", "resp*resp", "tok_len*tok_len", "theta_a*resp", "theta_a*tok_len"],
    "wide_acc_resp": ["acc", "resp", "acc*acc", "resp*resp", "acc*resp"],
    "wide_acc_resp_length": ["acc", "resp", "acc*acc", "resp*resp", "acc*resp", "tok_len", "tok_len*tok_len", "acc*tok_len", "resp*tok_len"],
}
STREAMS: list[list[str]] = [[r for r in RUNGS if r[0].isdigit()], [r for r in RUNGS if r.startswith("wide")]]


def _scored(traits: DataFrame) -> DataFrame:
    """Traits with ``z_<name>`` beside each."""
    w = Window.partitionBy("bench")
    return traits.select("bench", "model_id", *TRAITS, *[((F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + TINY)).alias(f"z_{c}") for c in TRAITS])


def _term(name: str) -> Column:
    first, *rest = name.split("*")
    out = F.col(f"z_{first}")
    for c in rest:
        out = out * F.col(f"z_{c}")
    return out


def _factor(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x, mode="r") if len(x) else x


def rung_residuals(traits: DataFrame, targets: list[str], rungs: dict[str, list[str]] = RUNGS) -> DataFrame:
    """``bench, rung, model_id`` and ``r_<target>`` for each target: least-squares residuals on a rung's covariates and an intercept.

    One (benchmark, model) is one row; of a rung, rows lacking a covariate or any of the targets have null residuals.
    """
    cols = F.array(*[F.struct(F.lit(n).alias("rung"), F.array(*map(_term, cs), F.lit(1.0)).alias("x")) for n, cs in rungs.items()])
    ys = F.array(*[F.col(t) for t in targets])
    long = _scored(traits).select("bench", "model_id", ys.alias("y"), F.explode(cols).alias("_r")).select("bench", "model_id", "y", "_r.*")
    whole = F.forall(F.concat("x", "y"), lambda v: v.isNotNull() & ~F.isnan(v))

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for f in frames:
            for key, g in f.groupby(["bench", "rung"]):
                new = np.column_stack([np.stack(g["x"].to_list()), np.stack(g["y"].to_list())]).astype(float)
                held[key] = _factor(np.vstack([held[key], new]) if key in held else new)
        yield pd.DataFrame([(*k, row.tolist()) for k, r in held.items() for row in r], columns=["bench", "rung", "row"])

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        r = _factor(np.stack(g["row"].to_list()).astype(float))
        p = r.shape[1] - len(targets)
        beta, *_ = np.linalg.lstsq(r[:, :p], r[:, p:], rcond=None)
        return pd.DataFrame({"bench": [key[0]], "rung": [key[1]], "beta": [beta.T.tolist()]})

    factors = long.where(whole).select("bench", "rung", "x", "y").mapInPandas(reduce, "bench string, rung string, row array<double>")
    betas = factors.groupBy("bench", "rung").applyInPandas(solve, "bench string, rung string, beta array<array<double>>")
    joined = long.join(F.broadcast(betas), ["bench", "rung"], "left")  # a row per benchmark and rung
    fitted = lambda k: F.aggregate(F.zip_with("x", F.col("beta")[k], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return joined.select("bench", "rung", "model_id", *[F.when(whole, F.col("y")[k] - fitted(k)).alias(f"r_{t}") for k, t in enumerate(targets)])


def _sides(residuals: DataFrame, traits: DataFrame, first: str, second: str) -> DataFrame:
    """``rung, model_id, a, b``: residuals of the response trait for models of both benchmarks."""
    side = lambda n, c: residuals.where(F.col("bench") == n).select("rung", "model_id", F.col("r_theta_c").alias(c))
    return side(first, "a").join(side(second, "b"), ["rung", "model_id"])


def ladder_table(traits: DataFrame, first: str, second: str, rungs: dict[str, list[str]] = RUNGS) -> DataFrame:
    """A row per rung: correlation of both benchmarks' residuals and, per benchmark (``_a, _b``), share and size of the residual
    variance, R2, correlation with ``theta_a`` and, on the wide rungs, with the confidence left by the same covariates.

    Correlations need six complete pairs and residuals above ``LEAST_SHARE`` of the variance, else null. ``signs``: whether
    the last agree in sign on both benchmarks, empty on other rungs.
    """
    res = checkpointed(rung_residuals(traits, ["theta_c", "conf"], rungs))  # read by five branches
    own = res.join(traits.select("bench", "model_id", "theta_a", "theta_c"), ["bench", "model_id"])
    stats = own.groupBy("rung", "bench").agg(
        F.var_pop("r_theta_c").alias("var"), (F.var_pop("r_theta_c") / (F.var_pop("theta_c") + TINY)).alias("share"),
        guarded_corr("r_theta_c", "theta_a", LEAST_PAIRS).alias("with_theta"), guarded_corr("r_theta_c", "r_conf", LEAST_PAIRS).alias("with_conf"),
    )
    there = F.col("share") > LEAST_SHARE
    wide = F.col("rung").startswith("wide")

    def side(name: str, end: str) -> DataFrame:
        got = stats.where(F.col("bench") == name)
        return got.select("rung", F.col("share").alias(f"share_{end}"), (1 - F.col("share")).alias(f"r2_{end}"), F.col("var").alias(f"var_{end}"), F.when(there, F.col("with_theta")).alias(f"with_theta_{end}"), F.when(there & wide, F.col("with_conf")).alias(f"with_conf_{end}"))

    pairs = _sides(res, traits, first, second).groupBy("rung").agg(guarded_corr("a", "b", LEAST_PAIRS).alias("corr"), F.count("*").alias("n_pairs"))
    out = pairs.join(side(first, "a"), "rung").join(side(second, "b"), "rung")
    both = (F.col("share_a") > LEAST_SHARE) & (F.col("share_b") > LEAST_SHARE)
    signs = F.when(~wide, "").when(F.signum("with_conf_a") == F.signum("with_conf_b"), "SAME").otherwise("NOT_SAME")
    return out.withColumn("corr", F.when(both, F.col("corr"))).withColumn("signs", signs)


def stream_states(n: int, streams: list[list[str]] = STREAMS, n_perm: int = 200, seed: int = 0, block: int = 25) -> pd.DataFrame:
    """``rung, first, last, key, pos``: the generator's state before each block of permutations.

    A stream runs through its rungs in order. The states are found by walking the stream once; no permutation is kept, and
    a state has 624 words, so what is sent does not grow with the rows.
    """
    out = []
    for names in streams:
        rng = np.random.RandomState(seed)
        for rung in names:
            for at in range(0, n_perm, block):
                _, key, pos, *_ = rng.get_state()
                last = min(at + block, n_perm)
                out.append((rung, at, last, key.astype("<u4").tobytes(), int(pos)))
                for _ in range(at, last):
                    rng.permutation(n)
    return pd.DataFrame(out, columns=["rung", "first", "last", "key", "pos"])


def ladder_nulls(traits: DataFrame, first: str, second: str, rungs: dict[str, list[str]] = RUNGS, streams: list[list[str]] = STREAMS, n_perm: int = 200, seed: int = 0) -> DataFrame:
    """``rung, perm, r``: correlation of the first benchmark's residuals with shuffled ones of the second, models in order of id.

    Permutations are those of one generator per stream, drawn inside tasks from the states before each block. The
    residuals of a rung travel as one pair of arrays, a value per model of both benchmarks.
    """
    pairs = _sides(rung_residuals(traits, ["theta_c"], rungs), traits, first, second)
    arrays = pairs.groupBy("rung").agg(F.sort_array(F.collect_list(F.struct("model_id", "a", "b"))).alias("p")).select("rung", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    ids = [traits.where(F.col("bench") == n).select("model_id") for n in (first, second)]
    n = ids[0].join(ids[1], "model_id").count()
    names = [[r for r in s if r in rungs] for s in streams]
    states = traits.sparkSession.createDataFrame(stream_states(n, names, n_perm, seed), "rung string, first int, last int, key binary, pos int")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                rng = np.random.RandomState()
                rng.set_state(("MT19937", np.frombuffer(r.key, "<u4"), r.pos))
                a, b = np.array(r.a, float), np.array(r.b, float)
                values = [_pearson(a, b[rng.permutation(len(b))]) for _ in range(r.first, r.last)]
                yield pd.DataFrame({"rung": r.rung, "perm": range(r.first, r.last), "r": values})

    blocks = states.join(arrays, "rung").repartition(max(1, len(rungs) * n_perm // 50), "rung", "first")
    out = blocks.mapInPandas(draw, "rung string, perm int, r double")
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def _pearson(a: np.ndarray, b: np.ndarray) -> float:
    both = np.isfinite(a) & np.isfinite(b)
    if both.sum() < LEAST_PAIRS:
        return np.nan
    x, y = a[both] - a[both].mean(), b[both] - b[both].mean()
    size = np.sqrt((x @ x) * (y @ y))
    return float(x @ y / size) if size > 0 else np.nan


def null_summary(nulls: DataFrame) -> DataFrame:
    """``rung, n, mean, p95_abs, p95``: mean and exact 95 % points of the null correlations that are there."""
    return nulls.groupBy("rung").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.percentile(F.abs("r"), 0.95).alias("p95_abs"), F.percentile("r", 0.95).alias("p95"))


# The pairs whose correlation is reported within a benchmark, and the columns compared across two.
WITHIN = [("theta_c", c) for c in ("theta_a", "signed", "acc", "resp", "conf", "gauge", "tok_len")] + [("theta_a", c) for c in ("acc", "resp", "conf", "signed")]
ACROSS = ["theta_a", "theta_c", "acc", "resp", "conf", "signed", "gauge", "tok_len"]
BASES = {"base": ["theta_a", "resp"], "more": ["theta_a", "resp", "gauge", "tok_len"]}


def loadings(traits: DataFrame) -> DataFrame:
    """``bench, name, value``: correlations of the traits with every score, R2, share, size of what a small and a larger base leave
    and its correlation with confidence, and the spread of every column. Null where too few values or none of a spread.
    """
    corr = [guarded_corr(a, b, LEAST_PAIRS).alias(f"{a}~{b}") for a, b in WITHIN]
    spread = [F.stddev_pop(c).alias(f"std_{c}") for c in TRAITS if c != "signed"]
    plain = traits.groupBy("bench").agg(*corr, *spread)
    res = rung_residuals(traits, ["theta_c"], BASES).join(traits.select("bench", "model_id", "theta_c", "conf"), ["bench", "model_id"])
    share = F.var_pop("r_theta_c") / (F.var_pop("theta_c") + TINY)
    left = res.groupBy("bench", "rung").agg(share.alias("share"), F.var_pop("r_theta_c").alias("var"), guarded_corr("r_theta_c", "conf", LEAST_PAIRS).alias("with_conf"))
    left = left.withColumn("r2", 1 - F.col("share")).withColumn("with_conf", F.when(F.col("share") > LEAST_SHARE, F.col("with_conf")))
    long = left.unpivot(["bench", "rung"], ["share", "var", "with_conf", "r2"], "what", "value").select("bench", F.concat("rung", F.lit("_"), "what").alias("name"), "value")
    return plain.unpivot(["bench"], [c for c in plain.columns if c != "bench"], "name", "value").unionByName(long)


def across(traits: DataFrame, first: str, second: str) -> DataFrame:
    """``name, n, value``: correlation across two benchmarks of each column over models of both, and of the correctness trait left by accuracy."""
    res = rung_residuals(traits, ["theta_a"], {"acc": ["acc"]}).select("bench", "model_id", F.col("r_theta_a").alias("theta_a_left"))
    rows = traits.join(res, ["bench", "model_id"])
    names = [*ACROSS, "theta_a_left"]
    side = lambda n, e: rows.where(F.col("bench") == n).select("model_id", *[F.col(c).alias(f"{c}_{e}") for c in names])
    both = side(first, "1").join(side(second, "2"), "model_id")
    wide = both.agg(F.count("*").alias("n"), *[guarded_corr(f"{c}_1", f"{c}_2", LEAST_PAIRS).alias(c) for c in names])
    return wide.unpivot(["n"], names, "name", "value").select("name", "n", "value")
