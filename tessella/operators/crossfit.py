"""Features of every model in every training and scoring context, without using its own organisation.

A base context (an outer fold, or an inner fold inside one) has training organisations and scored ones.
Scored models are described against all training organisations. Training models are described against
the training organisations outside their own of ``aux`` folds, so that no model's own organisation is
in the reference set it is held against. Folds inside an outer training set are the inner ones, so these
sets come up twice; sets that are equal share one ``ref_key`` and are fitted once.

Observations are summed per item and organisation before they meet the reference sets; what depends on
the lines of reference models is one join of observations with positions, summed map-side by set.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import context_sums, descriptors, relational, structure

AB = ["a1", "a2", "a3", "a4", "a5", "b1", "b2", "b3", "b4", "b5", "b6", "b7"]
C, D = ["c1", "c2", "c3", "c4"], ["d1", "d2", "d3", "d4"]
METRICS = [*AB, *C, *D]


def crossfit_contexts(orgs: DataFrame, outer: int = 5, inner: int = 4, aux: int = 4) -> DataFrame:
    """``context, base, outer, inner, part, org_id, role, ref_key``.

    ``base`` is a context of ``structure.contexts``. Its ``<base>/scored`` (part ``scored``) describes the
    scored organisations, its ``<base>/aux<k>`` (part ``train``) those of fold k of the training ones. A
    fold without organisations to score or to refer to gives no context.
    """
    base = structure.contexts(orgs, outer, inner).select(F.col("context").alias("base"), "outer", "inner", "org_id", "role")
    scored = base.withColumn("context", F.concat("base", F.lit("/scored"))).withColumn("part", F.lit("scored"))
    order = Window.partitionBy("base").orderBy(F.sha2(F.concat(F.lit("20260914|inner|"), "org_id"), 256), "org_id")
    train = base.where("role = 'reference'").withColumn("_f", ((F.row_number().over(order) - 1) % aux).cast("int"))
    train = train.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(aux - 1)))).withColumn("role", F.when(F.col("_f") == F.col("_k"), "scored").otherwise("reference"))
    train = train.withColumn("context", F.concat("base", F.lit("/aux"), "_k")).withColumn("part", F.lit("train")).drop("_f", "_k")
    both = scored.unionByName(train)
    keys = both.where("role = 'reference'").groupBy("context").agg(structure.set_hash("org_id").alias("ref_key"))
    asked = both.where("role = 'scored'").select("context").distinct()
    return both.join(keys, "context").join(asked, "context").select("context", "base", "outer", "inner", "part", "org_id", "role", "ref_key")


def start_positions(obs: DataFrame, members: DataFrame, least_models: int = 20) -> DataFrame:
    """``ref_key, direction, item_id, b``: standardised negative item means of each reference set, a direction for each half.

    ``obs`` carries ``half``; ``members``: ``ref_key, org_id``.
    """
    per_org = obs.groupBy("half", "item_id", "org_id").agg(F.sum("ell").alias("s"), F.count("*").alias("n"))
    items = per_org.join(members, "org_id").groupBy("ref_key", F.col("half").alias("direction"), "item_id").agg((F.sum("s") / F.sum("n")).alias("m"), F.sum("n").alias("n")).where(F.col("n") >= least_models)
    w = Window.partitionBy("ref_key", "direction")
    sd = F.stddev_pop("m").over(w)
    return items.select("ref_key", "direction", "item_id", ((F.avg("m").over(w) - F.col("m")) / F.when(sd > 1e-12, sd)).alias("b")).where("b IS NOT NULL")


def fitted_positions(obs: DataFrame, members: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """The same from bilinear fits of all sets and directions at once, and the fits' status."""
    rows = obs.join(members, "org_id").withColumnRenamed("half", "direction").select("ref_key", "direction", "model_id", "item_id", "ell")
    b, _, status = structure.als_reference(structure.checkpointed(rows), ["ref_key", "direction"], **limits)
    return b, status


def cached_positions(obs: DataFrame, members: DataFrame, path: str, fit: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """Positions of all sets, and how many sets were fitted for them: those in the store at ``path`` are read, the others fitted and added.

    A set is found again by its organisations and by the content of the observations, so changed data are fitted
    anew. ``fit(obs, members)`` gives ``ref_key, direction, item_id, b``. What one call adds carries its own
    name, and counts only once the list of its sets is written, so a call that was cut off leaves nothing behind.
    """
    spark = obs.sparkSession
    data = relational.content_hash(obs).select(F.concat_ws("|", "n", "digest")).first()[0]
    keyed = members.withColumn("key", F.sha2(F.concat_ws("|", "ref_key", F.lit(data)), 256))
    asked = keyed.select("ref_key", "key").distinct()
    there = _exists(spark, f"{path}/sets")
    known = spark.read.parquet(f"{path}/sets") if there else spark.createDataFrame([], "key string, call string")
    new = structure.checkpointed(asked.join(known, "key", "left_anti"))
    n = new.count()
    if n:
        call = uuid.uuid4().hex
        found = fit(obs, keyed.join(new.select("key"), "key", "left_semi").drop("key")).join(new, "ref_key")
        found.select("key", "direction", "item_id", "b", F.lit(call).alias("call")).write.mode("append").parquet(f"{path}/positions")
        new.select("key", F.lit(call).alias("call")).write.mode("append").parquet(f"{path}/sets")
    known, stored = spark.read.parquet(f"{path}/sets"), spark.read.parquet(f"{path}/positions")
    first = known.groupBy("key").agg(F.min("call").alias("call"))  # two calls at once may both have fitted a set
    return stored.join(first, ["key", "call"]).join(asked, "key").select("ref_key", "direction", "item_id", "b"), n


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def with_other_half(obs: DataFrame, members: DataFrame, positions: DataFrame, least_models: int = 20, cells: DataFrame | None = None) -> DataFrame:
    """Positions of both halves in each direction's gauge: those of the other half from the lines of the reference models.

    ``cells``: ``obs`` as ``context_sums.packed`` gives them, if they are there.
    """
    numbers = context_sums.Numbers(obs, members)
    cells = context_sums.packed(obs, numbers) if cells is None else cells
    of: dict[str, list[int]] = {}
    for r in members.select("ref_key", "org_id").distinct().collect():  # sets x organisations
        of.setdefault(r["org_id"], []).append(numbers.set[r["ref_key"]])
    other = context_sums.other_half(cells, of, numbers, numbers.directions(positions), least_models)
    return positions.select("ref_key", F.col("direction").cast("int").alias("direction"), "item_id", "b").unionByName(other)


def _scored(contexts: DataFrame, numbers: context_sums.Numbers) -> dict[str, list[tuple[str, int]]]:
    """The contexts that score each organisation, with their sets."""
    out: dict[str, list[tuple[str, int]]] = {}
    for r in contexts.where("role = 'scored'").select("context", "ref_key", "org_id").distinct().collect():  # contexts x organisations
        out.setdefault(r["org_id"], []).append((r["context"], numbers.set[r["ref_key"]]))
    return out


def projections(obs: DataFrame, contexts: DataFrame, positions: DataFrame, least_items: int = 100) -> DataFrame:
    """``context, model_id, theta, log_s, log_sigma, reason`` of each scored model on half 0, on that half's positions."""
    first = obs.where("half = 0").select("model_id", "org_id", "item_id", "ell")
    numbers = context_sums.Numbers(first, contexts.where("role = 'reference'").select("ref_key"))
    return context_sums.projections(context_sums.packed(first, numbers), _scored(contexts, numbers), numbers.directions(positions.where("direction = 0"))[0], least_items)


def context_metrics(obs: DataFrame, contexts: DataFrame, positions: DataFrame, least_items: int = 100, cells: DataFrame | None = None) -> DataFrame:
    """``context, model_id``, C and D metrics and the projection of each scored model; what can't be computed is null.

    ``obs`` carries ``half``; ``positions`` come from ``with_other_half``. The projection uses half 0. ``cells`` as there.
    """
    members = contexts.where("role = 'reference'").select("ref_key", "org_id").distinct()
    numbers = context_sums.Numbers(obs, members)
    cells = context_sums.packed(obs, numbers) if cells is None else cells
    scored = _scored(contexts, numbers)
    ease = structure.reference_ease(obs, members).where("w IS NOT NULL").select("ref_key", "item_id", "w", F.round("w", 12).alias("rounded")).toPandas()  # a row per set and item
    return context_sums.metrics(cells, scored, numbers, ease, numbers.directions(positions), least_items)


def feature_table(summaries: DataFrame, ab: DataFrame, metrics: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row per base context and model: summaries, the 20 metrics, a missing flag for each, and the projection.

    ``role`` is that of the base context: ``reference`` rows train, ``scored`` rows are predicted.
    """
    where = contexts.where("role = 'scored'").select("context", "base", "outer", "inner", "org_id", F.when(F.col("part") == "scored", "scored").otherwise("reference").alias("role"))
    rows = summaries.join(ab.select("model_id", *AB), "model_id").join(where, "org_id").join(metrics, ["context", "model_id"])
    flags = [F.col(m).isNull().cast("double").alias(f"m_{m}") for m in METRICS]
    return rows.select("base", "outer", "inner", "role", "context", *summaries.columns, *METRICS, *flags, "theta", "log_s", "log_sigma", "reason")


def halved(obs: DataFrame) -> DataFrame:
    """Observations with the half of their item, cut off from how they were made, so that all branches read one table."""
    obs = structure.checkpointed(obs)
    halves = structure.checkpointed(descriptors.item_halves(obs).select("item_id", F.col("half").cast("int").alias("half")))
    return obs.join(F.broadcast(halves), "item_id")  # a row per item of the benchmark
