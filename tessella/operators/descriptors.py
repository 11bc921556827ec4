"""Per-model descriptors from observations: accuracy, calibration, ranked risk, error structure.

Every function takes observations and the columns that name a group (``by``, default the model), and
returns one row per group. A metric that cannot be computed is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import average_rank, edge_bin, equal_bin, hash_rank

MODEL = ["model_id"]


def _binned(obs: DataFrame, by: list[str], bin_col) -> DataFrame:
    cells = obs.groupBy(*by, bin_col.alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("mc"), F.avg(F.col("y").cast("double")).alias("my"))
    return cells.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def means(obs: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """Accuracy, confidence, overconfidence, Brier score, entropy and margin."""
    out = obs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("acc"), F.avg("c").alias("conf"),
        F.avg("brier").alias("brier"), F.avg("h").alias("h"), F.avg("margin").alias("margin"),
    )
    return out.withColumn("over", F.col("conf") - F.col("acc"))


def calibration(obs: DataFrame, by: list[str] = MODEL, edges: bool = False) -> DataFrame:
    """REL10 and ECE10 over ten equal bins; ``edges`` bins by explicit decimals instead of by floor."""
    gap = F.col("mc") - F.col("my")
    return _binned(obs, by, edge_bin("c") if edges else equal_bin("c")).groupBy(*by).agg(F.sum(F.col("w") * gap * gap).alias("rel10"), F.sum(F.col("w") * F.abs(gap)).alias("ece10"))


def resolution(obs: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """A3: spread of the bins' accuracies about the group's."""
    cells = _binned(obs, by, equal_bin("c"))
    cells = cells.withColumn("acc", F.sum(F.col("w") * F.col("my")).over(Window.partitionBy(*by)))
    return cells.groupBy(*by).agg(F.sum(F.col("w") * F.pow(F.col("my") - F.col("acc"), 2)).alias("a3"))


def auroc(obs: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """A1: area under the curve of confidence against correctness, ties at one half; null for a single class."""
    ranked = obs.select(*by, "y", average_rank(by, "c").alias("r"))
    sums = ranked.groupBy(*by).agg(F.sum(F.when(F.col("y"), F.col("r"))).alias("r"), F.count_if("y").alias("p"), F.count("*").alias("n"))
    q = F.col("n") - F.col("p")
    value = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.when((F.col("p") > 0) & (q > 0), F.col("p") * q)
    return sums.select(*by, value.alias("a1"), F.when(value.isNull(), "SINGLE_CLASS").otherwise("").alias("a1_reason"))


def ranked_risk(obs: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """A2 (mean running error), A4, A5 (first 10 % and 25 %), R50 and R at full coverage, most confident first."""
    order = Window.partitionBy(*by).orderBy(F.col("c").desc(), "item_id")
    rows = obs.select(*by, "e", F.row_number().over(order).alias("rn"), F.count("*").over(Window.partitionBy(*by)).alias("n"), F.avg("e").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    part = lambda q: F.avg(F.when(F.col("rn") <= F.ceil(F.lit(q) * F.col("n")), F.col("e")))
    half = F.avg(F.when(F.col("rn") <= F.floor((F.col("n") + 1) / 2), F.col("e")))
    return rows.groupBy(*by).agg(F.avg("run").alias("a2"), part(0.10).alias("a4"), part(0.25).alias("a5"), half.alias("r50"), F.avg("e").alias("r100"))


def error_means(obs: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """B1-B4, B6, B7."""
    e, c = F.col("e"), F.col("c")
    return obs.groupBy(*by).agg(F.avg("nll").alias("b1"), F.avg(e * c).alias("b2"), F.avg(e * c * c).alias("b3"), F.avg("z").alias("b4"), F.avg("depth").alias("b6"), F.avg("hn").alias("b7"))


def top_loss(obs: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """B5: mean of the largest tenth of z."""
    order = Window.partitionBy(*by).orderBy(F.col("z").desc(), "item_id")
    rows = obs.select(*by, "z", F.row_number().over(order).alias("rn"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    return rows.where(F.col("rn") <= F.ceil(F.lit(0.10) * F.col("n"))).groupBy(*by).agg(F.avg("z").alias("b5"))


def item_halves(obs: DataFrame) -> DataFrame:
    """``item_id, half``: items dealt to two halves by a fixed shuffle."""
    return obs.select("item_id").distinct().select("item_id", (hash_rank("item_id") % 2).alias("half"))


def with_splits(obs: DataFrame) -> DataFrame:
    """Each observation in the full set and in the half of its item (``part``: full, half0, half1)."""
    both = obs.join(item_halves(obs), "item_id")
    return both.withColumn("part", F.explode(F.array(F.lit("full"), F.concat(F.lit("half"), F.col("half").cast("string")))))


def one_pass(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """``by, n, c, y``, each of ``sums``, ``rel10, ece10, a3``: everything from one shuffle by group.

    Bins are summed first and then the groups, which the same partitioning serves; values must not be null.
    """
    y = F.col("y").cast("double")
    cells = rows.groupBy(*by, equal_bin("c").alias("bin")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum(y).alias("y"), *[F.sum(e).alias(k) for k, e in sums.items()])
    gap = F.col("c") - F.col("y")
    out = cells.groupBy(*by).agg(
        *[F.sum(k).alias(k) for k in ("n", "c", "y", *sums)],
        F.sum(gap * gap / F.col("n")).alias("rel10"), F.sum(F.abs(gap)).alias("ece10"), F.sum(F.col("y") * F.col("y") / F.col("n")).alias("a3"),
    )
    share = {k: (F.col(k) / F.col("n")).alias(k) for k in ("rel10", "ece10")}
    spread = (F.col("a3") / F.col("n") - F.pow(F.col("y") / F.col("n"), 2)).alias("a3")
    return out.select(*by, "n", "c", "y", *sums, *share.values(), spread)


def in_confidence_order(obs: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``rn``, the place from the most confident on, and ``n``, the size of the group."""
    part = Window.partitionBy(*by)
    return obs.withColumn("rn", F.row_number().over(part.orderBy(F.col("c").desc(), "item_id"))).withColumn("n", F.count("*").over(part))


def half_coverage(rn: str = "rn", n: str = "n") -> Column:
    return F.col(rn) <= F.floor((F.col(n) + 1) / 2)


def ab_metrics(obs: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """All A and B metrics of valid observations: one shuffle by group, three orders in it, no join."""
    part = Window.partitionBy(*by)
    top, rising = part.orderBy(F.col("c").desc(), "item_id"), part.orderBy("c")
    rows = in_confidence_order(obs.select(*by, "item_id", "y", "c", "e", "z", "nll", "depth", "hn"), by)
    rows = rows.withColumn("run", F.avg("e").over(top.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("r", F.rank().over(rising) + (F.count("*").over(rising.rangeBetween(0, 0)) - 1) / 2)
    rows = rows.withColumn("zn", F.row_number().over(part.orderBy(F.col("z").desc(), "item_id")))
    e, c = F.col("e"), F.col("c")
    first = lambda col, q, place="rn": F.when(F.col(place) <= F.ceil(F.lit(q) * F.col("n")), F.col(col)).otherwise(0.0)
    sums = {
        "r": F.when(F.col("y"), F.col("r")).otherwise(0.0), "a2": F.col("run"), "a4": first("e", 0.10), "a5": first("e", 0.25), "b1": F.col("nll"), "b2": e * c, "b3": e * c * c,
        "b4": F.col("z"), "b5": first("z", 0.10, "zn"), "b6": F.col("depth"), "b7": F.col("hn"),
    }
    out = one_pass(rows, by, sums)
    n, p = F.col("n"), F.col("y")
    a1 = (F.col("r") - p * (p + 1) / 2) / F.when((p > 0) & (p < n), p * (n - p))
    shares = [(F.col(k) / n).alias(k) for k in ("b1", "b2", "b3", "b4", "b6", "b7")]
    tops = [(F.col(k) / F.ceil(F.lit(q) * n)).alias(k) for k, q in (("a4", 0.10), ("a5", 0.25), ("b5", 0.10))]
    reason = F.when(a1.isNull(), "SINGLE_CLASS").otherwise("").alias("a1_reason")
    return out.select(*by, a1.alias("a1"), reason, (F.col("a2") / n).alias("a2"), "a3", *tops, *shares)
