"""Joins, set checks, de-duplication and eligibility over models, items and organisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.adapters import first_row_wins, last_row_wins

__all__ = ["first_row_wins", "last_row_wins"]


def deny(rows: DataFrame, masked: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not on the deny list."""
    return rows.join(masked.select(key).distinct(), key, "left_anti")


def latest_path(files: DataFrame, needle: str) -> DataFrame:
    """``repo, path``: per repository the last path, by name, that holds ``needle``."""
    return files.where(F.lower("path").contains(needle) & F.col("path").endswith(".parquet")).groupBy("repo").agg(F.max("path").alias("path"))


def match_gold(rows: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the gold record of the first key that matches, in order; rows without any match fall away.

    ``gold`` has ``key`` (unique) and payload columns.
    """
    payload = [c for c in gold.columns if c != "key"]
    out = rows
    for i, k in enumerate(keys):
        side = gold.select(F.col("key").alias(k), F.struct(*payload).alias(f"_g{i}"))
        out = out.join(side, k, "left")
    best = F.coalesce(*[F.col(f"_g{i}") for i in range(len(keys))])
    out = out.withColumn("_best", best).where("_best IS NOT NULL")
    return out.select(*rows.columns, *[F.col("_best")[c].alias(c) for c in payload])


def placed(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows with the ``position`` of their key in ``order`` (``key, position``); a key that is not listed stops the job."""
    unknown = F.raise_error(F.concat(F.lit("unknown id: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return rows.join(order.select(key, "position"), key, "left").withColumn("position", F.coalesce("position", unknown.cast("int")))


def with_truth(preds: DataFrame, targets: DataFrame) -> DataFrame:
    """Predictions with the targets of their model; a model without a target, or of another organisation there, stops the job."""
    truth = targets.withColumnRenamed("org_id", "_org").withColumn("_found", F.lit(True))
    fault = F.when(F.col("_found").isNull(), "no target for model ").when(~F.col("org_id").eqNullSafe(F.col("_org")), "organisations differ for model ")
    checked = F.when(fault.isNull(), F.col("org_id")).otherwise(F.raise_error(F.concat(fault, F.col("model_id"))).cast("string"))
    return preds.join(truth, "model_id", "left").withColumn("org_id", checked).drop("_org", "_found")


def eligibility(source: DataFrame, target: DataFrame, least_half: int, least_target: int) -> DataFrame:
    """Union of models with reasons against them: too few valid items in a half or the target, or two organisations.

    ``source``: ``model_id, org_id, n0, n1``; ``target``: ``model_id, org_id, n``.
    """
    both = source.withColumnRenamed("org_id", "so").join(target.withColumnRenamed("org_id", "to"), "model_id", "full_outer")
    reasons = F.concat_ws(
        ";", F.when(F.col("so").isNull(), "NO_SOURCE"), F.when(F.col("to").isNull(), "NO_TARGET"),
        F.when(F.least("n0", "n1") < least_half, f"SOURCE_HALF_LT{least_half}"), F.when(F.col("n") < least_target, f"TARGET_LT{least_target}"), F.when(F.col("so") != F.col("to"), "ORG_MISMATCH"),
    )
    return both.select("model_id", F.coalesce("so", "to").alias("org_id"), "n0", "n1", "n", reasons.alias("reasons"))


def covered_items(cells: DataFrame, share: float) -> DataFrame:
    """Cells of items that at least ``share`` of all models have."""
    models = cells.agg(F.countDistinct("model_id").alias("m"))
    items = cells.groupBy("item_id").agg(F.countDistinct("model_id").alias("k"))
    kept = items.join(F.broadcast(models)).where(F.col("k") >= F.lit(share) * F.col("m")).select("item_id")  # one row on the right
    return cells.join(kept, "item_id")


def family_of(models: DataFrame, families: DataFrame) -> DataFrame:
    """The first family listed for a model; a model without one is a family of its own."""
    first = first_row_wins(families, ["model_id"], ["line"]).select("model_id", "family")
    return models.join(first, "model_id", "left").withColumn("family", F.coalesce("family", "model_id"))


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``n_left_only, n_right_only, equal`` of two key sets."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    sides = x.join(y, key, "full_outer").agg(F.count_if(F.col("_b").isNull()).alias("n_left_only"), F.count_if(F.col("_a").isNull()).alias("n_right_only"))
    return sides.withColumn("equal", (F.col("n_left_only") == 0) & (F.col("n_right_only") == 0))


def flags(**conditions: Column) -> Column:
    """Names of the conditions that hold, joined by '|'."""
    return F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in conditions.items()])


def candidates(models: DataFrame, value: str = "acc", within: float = 0.02, least: int = 3) -> DataFrame:
    """Models of an organisation with ``least`` rows whose value is within ``within`` of its best."""
    w = Window.partitionBy("org_id")
    rows = models.withColumn("_top", F.max(value).over(w)).withColumn("_n", F.count("*").over(w))
    return rows.where((F.col("_n") >= least) & (F.col(value) >= F.col("_top") - F.lit(within))).drop("_top", "_n")


def pick_lowest(rows: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """One row per group: the lowest value, ties by ``tie``."""
    return first_row_wins(rows, by, [value, tie])


def fixed_stride(rows: DataFrame, order: str, k: int) -> DataFrame:
    """``k`` rows at evenly spaced places of the order, ends included."""
    numbered = rows.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    n = rows.agg(F.count("*").alias("_n"))
    at = rows.sparkSession.range(k).join(F.broadcast(n)).select(F.floor(F.col("id") * (F.col("_n") - 1) / F.lit(max(1, k - 1))).alias("_i")).distinct()
    return numbered.join(at, "_i").drop("_i")


def access_violations(request: DataFrame, allowed: DataFrame, outer_scored: DataFrame) -> DataFrame:
    """Why a label request must be refused: models outside the context, models left out, or organisations held out.

    ``request, allowed``: ``model_id, org_id``; ``outer_scored``: ``org_id`` of the outer test fold.
    """
    say = lambda df, why: df.select("model_id", F.lit(why).alias("violation"))
    extra = say(request.join(allowed, ["model_id", "org_id"], "left_anti"), "NOT_IN_CONTEXT")
    missing = say(allowed.join(request, ["model_id", "org_id"], "left_anti"), "MISSING_FROM_REQUEST")
    leaked = say(request.join(outer_scored.select("org_id").distinct(), "org_id", "left_semi"), "OUTER_TEST_ORG")
    return extra.unionByName(missing).unionByName(leaked)


def difference(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], atol: float = 0.0) -> DataFrame:
    """Cells in which two tables differ by more than ``atol``; nulls equal nulls, and missing rows differ."""
    x, y = a.select(*keys, F.lit(True).alias("_a"), *[F.col(v).alias(f"a_{v}") for v in values]), b.select(*keys, F.lit(True).alias("_b"), *[F.col(v).alias(f"b_{v}") for v in values])
    both = x.join(y, keys, "full_outer")
    one_sided = F.col("_a").isNull() | F.col("_b").isNull()
    parts = F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"a_{v}").cast("double").alias("left"), F.col(f"b_{v}").cast("double").alias("right")) for v in values])
    long = both.select(*keys, one_sided.alias("one_sided"), F.explode(parts).alias("d")).select(*keys, "one_sided", "d.*")
    same = F.col("left").eqNullSafe(F.col("right")) | F.coalesce(F.abs(F.col("left") - F.col("right")) <= atol, F.lit(False))
    return long.where(F.col("one_sided") | ~same)


def content_hash(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Order-free digest of a table: row count and a sum of row hashes, combined before the shuffle."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(rows.columns)])
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum(row.cast("decimal(20,0)")).cast("string").alias("digest"))
