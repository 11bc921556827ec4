"""Small reports: trajectories, trait variants, quartile roll-ups, manifest problems, formatted lines, seals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import equal_bin, guarded_corr
from tessella.operators.relational import content_hash


def trajectory(rows: DataFrame, by: list[str], step: str, value: str, last: int = 100) -> DataFrame:
    """``by, n, increases, first, last, trend``: rises of a series and its slope over the last steps."""
    w = Window.partitionBy(*by).orderBy(step)
    out = rows.select(*by, step, value, F.lag(value).over(w).alias("_prev"), F.row_number().over(w).alias("_i"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    recent = F.col("_i") > F.col("_n") - last
    x, y = F.when(recent, F.col("_i").cast("double")), F.when(recent, F.col(value))
    return out.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col(value) > F.col("_prev")).alias("increases"), F.min_by(value, "_i").alias("first"), F.max_by(value, "_i").alias("last"),
        (F.covar_pop(x, y) / F.when(F.var_pop(x) > 0, F.var_pop(x))).alias("trend"),
    )


def winsorised(rows: DataFrame, columns: list[str], p: float = 0.99) -> DataFrame:
    """Adds ``c_win`` (cut at the exact quantile) and ``c_drop`` (null above it) for each column."""
    cuts = rows.agg(*[F.percentile(c, p).alias(f"_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(cuts))  # one row on the right
    for c in columns:
        out = out.withColumn(f"{c}_win", F.least(F.col(c), F.col(f"_{c}"))).withColumn(f"{c}_drop", F.when(F.col(c) <= F.col(f"_{c}"), F.col(c)))
    return out.drop(*[f"_{c}" for c in columns])


def trait_variants(rows: DataFrame, x: str, y: str) -> DataFrame:
    """``raw, winsor, drop``: one correlation by three treatments of extreme values."""
    out = winsorised(rows, [x, y])
    return out.agg(guarded_corr(x, y).alias("raw"), guarded_corr(f"{x}_win", f"{y}_win").alias("winsor"), guarded_corr(f"{x}_drop", f"{y}_drop").alias("drop"))


def quartiles_twice(rows: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Quartiles of each inner group, then the medians of these over the outer group."""
    qs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    first = rows.groupBy(*outer, *inner).agg(F.percentile(value, qs).alias("q"))
    return first.groupBy(*outer).agg(*[F.median(F.col("q")[i]).alias(f"q{i + 1}") for i in range(3)])


def manifest_problems(rows: DataFrame, manifest: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``keys, problem``: rows that the manifest lacks, or lists otherwise."""
    listed = manifest.select(*keys, F.lit(True).alias("_there"), *[F.col(v).alias(f"_{v}") for v in values])
    joined = rows.join(listed, keys, "left")
    wrong = [F.when(F.col("_there") & ~F.col(v).eqNullSafe(F.col(f"_{v}")), F.lit(f"{v.upper()}_DIFFERS")) for v in values]
    problems = F.array_compact(F.array(F.when(F.col("_there").isNull(), F.lit("NOT_LISTED")), *wrong))
    return joined.select(*keys, F.explode(problems).alias("problem"))


def frozen_subset(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows of the listed ids with their ``place``; an id of the list that has no row is an error."""
    joined = order.join(rows, key, "left")
    return joined.withColumn("place", F.when(F.col("_row").isNotNull(), F.col("place")).otherwise(F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))))).drop("_row")


def report_line(*cells: Column) -> Column:
    """A Markdown table row; doubles to six places."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def fixed(x: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", x)


def seal(preds: DataFrame, by: list[str]) -> DataFrame:
    """Digest of sealed predictions by group."""
    return content_hash(preds, by)


def broken_seals(sealed: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose predictions are not those that were sealed."""
    a, b = sealed.select(*by, F.col("digest").alias("_a"), F.col("n").alias("_n")), now.select(*by, F.col("digest").alias("_b"), F.col("n").alias("_m"))
    both = a.join(b, by, "full_outer")
    return both.where(~(F.col("_a").eqNullSafe(F.col("_b")) & F.col("_n").eqNullSafe(F.col("_m")))).select(*by)


def headline(obs: DataFrame, halves: DataFrame, scores: list[str]) -> DataFrame:
    """One row: models, organisations, items, items of either half, occupied tenths of the confidence, range of each score."""
    sizes = halves.agg(F.count("*").alias("n_items"), F.count_if(F.col("half") == 0).alias("n_first"), F.count_if(F.col("half") == 1).alias("n_second"))
    ranges = [a for s in scores for a in (F.min(s).alias(f"{s}_min"), F.max(s).alias(f"{s}_max"))]
    counts = obs.agg(F.countDistinct("model_id").alias("n_models"), F.countDistinct("org_id").alias("n_orgs"), F.countDistinct(equal_bin("c")).alias("n_bins"), *ranges)
    return counts.crossJoin(sizes)  # one row on either side
