"""Reference populations: contexts of organisations, item ease, bilinear fits, projections, residual shape.

A context names the organisations that a fit may use (role ``reference``) and those it is applied to
(role ``scored``). Equal reference sets share one ``ref_key``, so each set is fitted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import guarded_corr, hash_rank


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop by a reliable checkpoint; the folder is the session's, if it has one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = context.getConf().get("spark.checkpoint.dir", None)
        if path is None:
            if not (context.getConf().get("spark.master", "") or "").startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            path = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(path)
    return df.checkpoint()


def folds(orgs: DataFrame, k: int, seed: str = "20260914") -> DataFrame:
    """``org_id, fold``: organisations dealt round robin after a fixed shuffle."""
    return orgs.select("org_id").distinct().select("org_id", (hash_rank("org_id", seed) % k).cast("int").alias("fold"))


def contexts(orgs: DataFrame, outer: int = 5, inner: int = 4) -> DataFrame:
    """``context, outer, inner, org_id, role, ref_key``; ``inner`` is null for the outer contexts."""
    dealt = folds(orgs, outer)
    per_outer = dealt.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    outer_rows = per_outer.select(F.concat(F.lit("o"), "outer").alias("context"), "outer", F.lit(None).cast("int").alias("inner"), "org_id", F.when(F.col("fold") == F.col("outer"), "scored").otherwise("reference").alias("role"))
    train = per_outer.where("fold <> outer")
    w = Window.partitionBy("outer").orderBy(F.sha2(F.concat(F.lit("20260914|inner|"), "org_id"), 256), "org_id")
    nested = train.withColumn("in_fold", ((F.row_number().over(w) - 1) % inner).cast("int")).withColumn("inner", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))))
    inner_rows = nested.select(F.concat(F.lit("o"), "outer", F.lit("i"), "inner").alias("context"), "outer", "inner", "org_id", F.when(F.col("in_fold") == F.col("inner"), "scored").otherwise("reference").alias("role"))
    both = outer_rows.unionByName(inner_rows)
    keys = both.where("role = 'reference'").groupBy("context").agg(set_hash("org_id").alias("ref_key"))
    return both.join(keys, "context")


def set_hash(col: str, trailing: bool = False):
    """sha256 over the sorted distinct values, one a line; ``trailing`` ends the last line as well."""
    lines = F.concat_ws("\n", F.array_sort(F.collect_set(col)))
    return F.sha2(F.concat(lines, F.lit("\n")) if trailing else lines, 256)


def largest_reference_set(obs: DataFrame, members: DataFrame) -> DataFrame:
    """``context, ref_key, n_models``, one row: the reference set with the most models; ties go to the lesser key, then context."""
    per_org = obs.groupBy("org_id").agg(F.countDistinct("model_id").alias("n"))
    size = members.where("role = 'reference'").join(per_org, "org_id").groupBy("context", "ref_key").agg(F.sum("n").alias("n_models"))
    return size.orderBy(F.col("n_models").desc(), "ref_key", "context").limit(1)


def reference_ease(obs: DataFrame, members: DataFrame, least_valid: int = 20) -> DataFrame:
    """``ref_key, item_id, w, n_ref, n_ref_orgs``: organisation-equal smoothed error rate of each item.

    ``members`` lists ``ref_key, org_id``. An item with fewer than ``least_valid`` responses has no ``w``.
    Responses are summed per organisation before they meet the sets.
    """
    per_org = obs.groupBy("item_id", "org_id").agg(F.sum("e").alias("k"), F.count("*").alias("n"))
    per_item = per_org.join(members.select("ref_key", "org_id").distinct(), "org_id").groupBy("ref_key", "item_id").agg(F.avg((F.col("k") + 0.5) / (F.col("n") + 1)).alias("w"), F.sum("n").alias("n_ref"), F.count("*").alias("n_ref_orgs"))
    return per_item.withColumn("w", F.when(F.col("n_ref") >= least_valid, 1 - F.col("w")))


def c_metrics(obs: DataFrame, ease: DataFrame, by: list[str]) -> DataFrame:
    """C1-C3 weighted error, error times confidence and score gap; C4 spread of c - y over four ease bins.

    ``ease`` carries ``item_id, w`` and those of ``by`` that ``obs`` shares with it. Fewer than four items give no C4.
    Items are binned by ease and, where ease is equal to twelve digits, by name: the order of a sum must not decide.
    """
    on = ["item_id", *[c for c in by if c in ease.columns and c in obs.columns]]
    rows = obs.join(ease.where("w IS NOT NULL"), on)
    order = Window.partitionBy(*by).orderBy(F.round("w", 12), "item_id")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*by))).withColumn("bin", F.floor(4 * (F.row_number().over(order) - 1) / F.col("n")))
    gap = F.col("c") - F.col("y").cast("double")
    bins = rows.groupBy(*by, "bin").agg(F.count("*").alias("m"), F.avg(gap).alias("g"), F.sum(F.col("w") * F.col("e")).alias("s1"), F.sum(F.col("w") * F.col("e") * F.col("c")).alias("s2"), F.sum(F.col("w") * F.col("z")).alias("s3"))
    bins = bins.withColumn("n", F.sum("m").over(Window.partitionBy(*by))).withColumn("mean", F.sum(F.col("m") * F.col("g")).over(Window.partitionBy(*by)) / F.col("n"))
    part = lambda c: F.sum(c) / F.first("n")
    spread = F.sum(F.col("m") / F.col("n") * F.pow(F.col("g") - F.col("mean"), 2))
    return bins.groupBy(*by).agg(part("s1").alias("c1"), part("s2").alias("c2"), part("s3").alias("c3"), F.when(F.first("n") >= 4, spread).alias("c4"))


def line_fit(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, a, s, var_b, var_ell`` of ell = a - s b; null where b does not vary."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ell").alias("me"), F.avg("b").alias("mb"), F.covar_pop("ell", "b").alias("cov"), F.var_pop("b").alias("var_b"), F.var_pop("ell").alias("var_ell"))
    g = g.withColumn("s", -F.col("cov") / F.when(F.col("var_b") > 1e-12, F.col("var_b")))
    return g.select(*by, "n", (F.col("me") + F.col("s") * F.col("mb")).alias("a"), "s", "var_b", "var_ell")


def project_source(rows: DataFrame, by: list[str], least_items: int = 100) -> DataFrame:
    """Per-model projection on item positions ``b``: a, s, sigma (population), theta, logs and a reason for failure."""
    return judged(line_fit(rows, by), rows, by, least_items)


def judged(fit: DataFrame, rows: DataFrame, by: list[str], least_items: int = 100) -> DataFrame:
    """The projection of lines that are fitted already (``by, n, a, s, var_b, var_ell``)."""
    resid = rows.join(fit.select(*by, "a", "s"), by).groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col("ell") - (F.col("a") - F.col("s") * F.col("b")), 2))).alias("sigma"))
    out = fit.join(resid, by)
    reason = (
        F.when(F.col("n") < least_items, f"EVALUATION_ITEMS_LT{least_items}").when(F.col("var_b") <= 1e-12, "B_VARIANCE_LE1E12").when(F.col("var_ell") <= 1e-6, "ELL_VARIANCE_LE1E6")
        .when(F.col("s") <= 1e-8, "S_LE1E8").when(F.col("sigma") <= 1e-8, "SIGMA_LE1E8").otherwise("")
    )
    ok = reason == ""
    theta = F.when(ok, F.col("a") / F.when(ok, F.col("s")))
    return out.select(*by, "n", "a", "s", "sigma", theta.alias("theta"), F.when(ok, F.log(F.when(ok, F.col("s")))).alias("log_s"), F.when(ok, F.log(F.when(ok, F.col("sigma")))).alias("log_sigma"), reason.alias("reason"))


def initial_positions(obs: DataFrame, by: list[str], least_models: int = 20) -> DataFrame:
    """``by, item_id, b``: standardised negative mean of ell of the items with enough models; null when degenerate."""
    items = obs.groupBy(*by, "item_id").agg(F.avg("ell").alias("m"), F.count("*").alias("n")).where(F.col("n") >= least_models)
    w = Window.partitionBy(*by)
    items = items.withColumn("sd", F.stddev_pop("m").over(w)).withColumn("mu", F.avg("m").over(w))
    return items.select(*by, "item_id", ((F.col("mu") - F.col("m")) / F.when(F.col("sd") > 1e-12, F.col("sd"))).alias("b"))


def _model_lines(batch: pa.RecordBatch, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and ell of all cells of a batch of whole models, the row of each, and ``a, s`` of each row; NaN where b does not vary."""
    size = np.diff(batch.column("j").offsets.to_numpy())
    j, ell = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("j", "ell"))
    row = np.repeat(np.arange(len(size)), size)
    mean = lambda v: np.bincount(row, v, len(size)) / size
    mb, me = mean(b[j]), mean(ell)
    db = b[j] - mb[row]
    var = mean(db * db)
    s = -mean(db * (ell - me[row])) / np.where(var > 1e-12, var, np.nan)
    return j, ell, row, me + s * mb, s


def _position_sums(models: DataFrame, b: np.ndarray) -> np.ndarray:
    """For each position the sums of s (a - ell) and s s over the models that have it, and how many of these have no slope."""
    sent = models.sparkSession.sparkContext.broadcast(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(sent.value)))
        for batch in batches:
            j, ell, row, a, s = _model_lines(batch, sent.value)
            flat = np.isnan(s)
            s, a = np.where(flat, 0.0, s)[row], np.where(flat, 0.0, a)[row]
            for k, v in enumerate((s * (a - ell), s * s, flat[row].astype(float))):
                total[k] += np.bincount(j, v, total.shape[1])
        at = np.flatnonzero(total.any(0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(v[at]) for v in total)], ["j", "num", "den", "flat"])

    found = models.select("j", "ell").mapInArrow(run, "j int, num double, den double, flat double").groupBy("j").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("flat").alias("flat")).toPandas()  # sets x items of the benchmark
    sent.unpersist()
    out = np.zeros((3, len(b)))
    out[:, found["j"].to_numpy(int)] = found[["num", "den", "flat"]].to_numpy(float).T
    return out


def als_reference(obs: DataFrame, by: list[str], tol: float = 1e-6, max_iter: int = 500, least_models: int = 20, least_items: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bilinear fit ell = a_m - s_m b_i for every group of ``by`` at once.

    Lines per model and positions per item alternate over the observed cells; each round standardises the
    positions and keeps the sign of the start. A round is one pass over whole models inside tasks; the driver holds
    the positions (groups x items of the benchmark) and sends them. Returns ``items (by, item_id, b)``, ``models (by,
    model_id, a, s)`` and ``status (by, reason, n_iter)``; a group that fails is in the status only.
    """
    spark = obs.sparkSession
    start = checkpointed(initial_positions(obs, by, least_models))
    size = obs.select(*by).distinct().join(start.groupBy(*by).agg(F.count("*").alias("n_items"), F.count("b").alias("n_b")), by, "left")
    placed = start.where("b IS NOT NULL").select(*by, "item_id", F.lit(True).alias("_on"))
    per_model = obs.select(*by, "model_id", "item_id").join(F.broadcast(placed), [*by, "item_id"], "left").groupBy(*by, "model_id").agg(F.count("_on").alias("n"))  # groups x items
    thin = per_model.where("n < 2").groupBy(*by).agg(F.count("*").alias("thin"))
    status = size.join(thin, by, "left").select(
        *by, F.when(F.coalesce("n_items", F.lit(0)) < least_items, "INSUFFICIENT_REFERENCE_ITEMS").when(F.col("n_b") == 0, "DEGENERATE_REFERENCE_INIT").when(F.col("thin") > 0, "REFERENCE_MODEL_ITEMS_LT2").otherwise("").alias("reason"),
    )
    status = checkpointed(status)
    good = status.where("reason = ''").select(*by)
    rows = start.where("b IS NOT NULL").join(F.broadcast(good), by).select(*by, "item_id", "b").orderBy(*by, "item_id").collect()  # groups x items of the benchmark
    keys = list(dict.fromkeys(tuple(r[c] for c in by) for r in rows))
    number = {k: n for n, k in enumerate(keys)}
    group, first = np.array([number[tuple(r[c] for c in by)] for r in rows], int), np.array([r["b"] for r in rows], float)
    types = ", ".join(f"{c} {status.schema[c].dataType.simpleString()}" for c in by)
    place = spark.createDataFrame([(*[r[c] for c in by], r["item_id"], n) for n, r in enumerate(rows)], f"{types}, item_id {dict(start.dtypes)['item_id']}, j int")
    cells = obs.where("ell IS NOT NULL").select(*by, "model_id", "item_id", "ell").join(F.broadcast(place), [*by, "item_id"])
    packed = cells.groupBy(*by, "model_id").agg(F.collect_list(F.struct("j", F.col("ell").cast("double").alias("ell"))).alias("_r"))
    packed = checkpointed(packed.select(*by, "model_id", F.col("_r.j").alias("j"), F.col("_r.ell").alias("ell")))

    n = len(keys)
    over = lambda v: np.bincount(group, np.where(np.isnan(v), 0.0, v), n)
    b = before = first
    mu, sd, sign = (np.ones(n) for _ in range(3))
    settled: dict[int, int] = {}
    failed: set[int] = set()
    for step in range(1, max_iter + 1 if n else 1):
        num, den, flat = _position_sums(packed, b)
        with np.errstate(invalid="ignore", divide="ignore"):
            raw = np.where((den > 1e-20) & (flat == 0), num / den, np.nan)
            there = over(np.where(np.isnan(raw), 0.0, 1.0))
            mu = over(raw) / there
            sd = np.sqrt(over((raw - mu[group]) ** 2) / there)
            z = (raw - mu[group]) / np.where(sd > 1e-12, sd, np.nan)[group]
        sign = np.where(over(z * first) < 0, -1.0, 1.0)
        before, b = b, sign[group] * z
        moved, lost = np.full(n, -np.inf), over(np.isnan(b).astype(float))
        np.maximum.at(moved, group, np.where(np.isnan(b - before), -np.inf, np.abs(b - before)))
        for k in range(n):
            if lost[k]:
                failed.add(k)
                settled.setdefault(k, step)
            elif moved[k] < tol:
                settled.setdefault(k, step)
        if len(settled) == n:
            break
    done = spark.createDataFrame([(*keys[k], at, k in failed) for k, at in settled.items()], f"{types}, n_iter int, lost boolean")
    status = status.join(F.broadcast(done), by, "left").select(
        *by, F.when(F.col("reason") != "", F.col("reason")).when(F.col("lost"), "DEGENERATE_REFERENCE_FIT").when(F.col("n_iter").isNull(), "ALS_NONCONVERGENCE").otherwise("").alias("reason"), "n_iter",
    )
    items = spark.createDataFrame([(*[r[c] for c in by], r["item_id"], float(v)) for r, k, v in zip(rows, group, b) if k in settled and k not in failed], f"{types}, item_id {dict(start.dtypes)['item_id']}, b double")
    sent = spark.sparkContext.broadcast((before, group, mu, sd * sign))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, group, mu, scale = sent.value
        for batch in batches:
            if len(batch):
                j, _, _, a, s = _model_lines(batch, b)
                of = group[j[batch.column("j").offsets.to_numpy()[:-1] - batch.column("j").offsets[0].as_py()]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, "model_id")), pa.array(a - s * mu[of], from_pandas=True), pa.array(s * scale[of], from_pandas=True)], [*by, "model_id", "a", "s"])

    models = packed.mapInArrow(lines, f"{types}, model_id {dict(obs.dtypes)['model_id']}, a double, s double")
    return items, models.join(F.broadcast(status.where("reason = ''").select(*by)), by), status


def project_reference_items(rows: DataFrame, models: DataFrame, by: list[str], least_models: int = 20) -> DataFrame:
    """``by, item_id, b, n_ref, denom``: positions of items on fitted lines, in the fit's own gauge."""
    joined = rows.join(models, [*by, "model_id"])
    out = joined.groupBy(*by, "item_id").agg(F.sum(F.col("s") * (F.col("a") - F.col("ell"))).alias("num"), F.sum(F.col("s") * F.col("s")).alias("denom"), F.count("*").alias("n_ref"))
    ok = (F.col("n_ref") >= least_models) & (F.col("denom") > 1e-20)
    return out.select(*by, "item_id", (F.col("num") / F.when(ok, F.col("denom"))).alias("b"), "n_ref", "denom")


def residuals(rows: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """``by, item_id, r, b``: what a fitted line leaves of ell."""
    return rows.join(fit.where("a IS NOT NULL AND s IS NOT NULL").select(*by, "a", "s"), by).select(*by, "item_id", (F.col("ell") - (F.col("a") - F.col("s") * F.col("b"))).alias("r"), "b")


def residual_shape(res: DataFrame, by: list[str]) -> DataFrame:
    """D1 share of energy in negative residuals, D2 excess kurtosis, D3 Spearman of |r| and b, D4 Pearson of r and b squared."""
    r, b = F.col("r"), F.col("b")
    place = lambda v: F.rank().over(Window.partitionBy(*by).orderBy(v)) + (F.count("*").over(Window.partitionBy(*by).orderBy(v).rangeBetween(0, 0)) - 1) / F.lit(2.0)
    ranked = res.select(*by, "r", "b", place(F.abs(r)).alias("x"), place(b).alias("y"))
    energy, var = F.sum(r * r), F.var_pop("r")
    return ranked.groupBy(*by).agg(
        F.when(energy > 1e-12, F.sum(F.pow(F.least(r, F.lit(0.0)), 2)) / F.when(energy > 1e-12, energy)).alias("d1"),
        F.when(var > 1e-12, F.kurtosis("r")).alias("d2"),
        guarded_corr("x", "y", 2, 1e-12).alias("d3"),
        guarded_corr("r", b * b, 2, 1e-12).alias("d4"),
    )


def combine_directions(shape: DataFrame, by: list[str], metrics: tuple[str, ...] = ("d1", "d2", "d3", "d4"), direction: str = "direction") -> DataFrame:
    """Mean over both directions; null with a reason naming the missing one unless both are there."""
    at = lambda m, d: F.max(F.when(F.col(direction) == d, F.col(m)))
    out = []
    for m in metrics:
        x, y = at(m, 0), at(m, 1)
        out += [((x + y) / 2).alias(m), F.concat_ws(";", F.when(x.isNull(), "H0:MISSING"), F.when(y.isNull(), "H1:MISSING")).alias(f"{m}_reason")]
    return shape.groupBy(*by).agg(*out)


def d_metrics(obs: DataFrame, halves: DataFrame, positions: DataFrame, by: list[str], least_items: int = 100) -> DataFrame:
    """D metrics: the line is fitted on one half's items and judged on the other, both ways.

    ``positions``: ``direction, item_id, b`` in the gauge of the direction's own fit (direction h fits half h).
    """
    rows = obs.join(halves, "item_id").join(positions.where("b IS NOT NULL"), "item_id")
    key = [*by, "direction"]
    fit = line_fit(rows.where("half = direction"), key)
    held = rows.where("half <> direction")
    enough = held.groupBy(*key).count().where(F.col("count") >= least_items).select(*key)
    return combine_directions(residual_shape(residuals(held.join(enough, key), fit, key), key), by)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
