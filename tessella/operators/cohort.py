"""The frozen cohort: listed models and items against a newer, fuller table, with every way in which they may disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import hash_rank


def cohort_problems(models: DataFrame, listed: DataFrame, items: DataFrame, listed_items: DataFrame, policy: DataFrame) -> DataFrame:
    """``problem, id``: why the newer table does not hold the frozen cohort; no row if it does.

    ``models``: ``model_id, org_id``, one row a model; ``listed``: the same as frozen. ``items``: ``item_id, place, half`` of
    the newer table; ``listed_items``: ``item_id, place`` as frozen; ``policy``: ``item_id`` of the items that have to go. The
    newer items must be the frozen ones without those of the policy, in the frozen order, and dealt to halves by the rule.
    An item breaks the order if its frozen place comes before that of the item before it. Tables are dimensions.
    """
    say = lambda df, key, why: df.select(F.lit(why).alias("problem"), F.col(key).alias("id"))
    now = models.select("model_id", F.col("org_id").alias("_org"))
    counted = listed.groupBy("model_id").agg(F.count("*").alias("_n"), F.min("org_id").alias("org_id")).join(now, "model_id", "left")
    kept = items.join(listed_items.select("item_id", F.col("place").alias("_frozen")), "item_id", "left")
    gone = listed_items.join(items.select("item_id"), "item_id", "left_anti")
    w = Window.orderBy("place", "item_id")
    ordered = kept.where("_frozen IS NOT NULL").withColumn("_before", F.lag("_frozen").over(w))
    dealt = items.select("item_id", "half", (hash_rank("item_id") % 2).alias("_rule"))
    found = [
        say(counted.where("_org IS NULL"), "model_id", "MODEL_ABSENT"),
        say(counted.where("_n > 1"), "model_id", "MODEL_REPEATED"),
        say(counted.where("_org <> org_id"), "model_id", "ORG_DIFFERS"),
        say(gone.join(policy.select("item_id"), "item_id", "left_anti"), "item_id", "ITEM_LOST"),
        say(kept.join(policy.select("item_id").distinct(), "item_id", "left_semi"), "item_id", "POLICY_ITEM_KEPT"),
        say(kept.where("_frozen IS NULL"), "item_id", "ITEM_ADDED"),
        say(ordered.where("_frozen < _before"), "item_id", "ITEM_ORDER"),
        say(dealt.where("NOT (half <=> _rule)"), "item_id", "HALF_RULE"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def cohort_summary(models: DataFrame, listed: DataFrame, items: DataFrame, listed_items: DataFrame) -> DataFrame:
    """One row: sizes of the frozen and the newer table, models outside, items removed, sizes of the halves, items that changed half.

    ``listed_items`` also has ``half``, by the frozen list.
    """
    m = models.join(listed.select("model_id", F.lit(1).alias("_in")).distinct(), "model_id", "left").agg(F.count("*").alias("n_full"), F.count_if(F.col("_in").isNull()).alias("n_outside"))
    c = listed.agg(F.countDistinct("model_id").alias("n_models"), F.countDistinct("org_id").alias("n_orgs"))
    both = items.select("item_id", "half").join(listed_items.select("item_id", F.col("half").alias("_was")), "item_id", "full_outer")
    i = both.agg(
        F.count("half").alias("n_items"), F.count_if(F.col("half").isNull()).alias("n_removed"), F.count_if(F.col("half") == 0).alias("n_first"), F.count_if(F.col("half") == 1).alias("n_second"), F.count_if(F.col("half") != F.col("_was")).alias("n_changed"),
    )
    return m.crossJoin(c).crossJoin(i)  # single rows


def frozen_rows(rows: DataFrame, listed: DataFrame, problems: DataFrame) -> DataFrame:
    """``rows`` of the listed models with their ``place``; the first problem, if there is one, is an error when rows are read."""
    worst = problems.agg(F.min(F.concat_ws(" ", "problem", "id")).alias("_why"), F.count("*").alias("_n"))
    joined = rows.join(listed.select("model_id", "place"), "model_id").crossJoin(F.broadcast(worst))  # one row
    refuse = F.raise_error(F.concat(F.lit("frozen cohort: "), "_why", F.lit(" and "), (F.col("_n") - 1).cast("string"), F.lit(" more")))
    return joined.withColumn("place", F.when(F.col("_n") == 0, F.col("place")).otherwise(refuse)).drop("_why", "_n")


def matrix_cells(cells: DataFrame, masked: DataFrame, share: float = 0.95, least_cells: int = 50) -> DataFrame:
    """Cells of the items that at least ``share`` of all models have, without ``masked`` items; a model that keeps fewer than
    ``least_cells`` cells with a finite value (``lp_mean``) is an error when its rows are read. Masked items count for no share.
    """
    models = cells.agg(F.countDistinct("model_id").alias("_m"))
    open_ = cells.join(F.broadcast(masked.select("item_id").distinct()), "item_id", "left_anti")
    kept = open_.groupBy("item_id").agg(F.countDistinct("model_id").alias("_k")).crossJoin(F.broadcast(models)).where(F.col("_k") >= F.lit(share) * F.col("_m")).select("item_id")  # one row on the right
    rows = open_.join(kept, "item_id")
    left = F.count_if(F.col("lp_mean").isNotNull() & ~F.isnan("lp_mean")).over(Window.partitionBy("model_id"))
    refuse = F.raise_error(F.concat(F.lit("too few cells: "), "model_id"))
    return rows.withColumn("_left", left).withColumn("model_id", F.when(F.col("_left") >= least_cells, F.col("model_id")).otherwise(refuse)).drop("_left")


def relabelled(rows: DataFrame, denied: DataFrame, by: str = "model_id") -> DataFrame:
    """Rows without denied items, ``n_kept`` counted anew per ``by``, with ``n_before`` and ``n_denied`` as provenance.

    ``denied``: ``item_id``; an entry listed twice counts once, one that no row has changes nothing.
    """
    marked = rows.join(F.broadcast(denied.select("item_id", F.lit(True).alias("_deny")).distinct()), "item_id", "left")
    w = Window.partitionBy(by)
    counted = marked.withColumn("n_before", F.count("*").over(w)).withColumn("n_denied", F.count("_deny").over(w))
    return counted.where("_deny IS NULL").drop("_deny").withColumn("n_kept", F.col("n_before") - F.col("n_denied"))
