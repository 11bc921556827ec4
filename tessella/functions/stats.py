"""Guarded statistics as column and frame functions. Missing is null throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(by: list[str], value: str) -> Column:
    """Rank from 1 with ties at their mean."""
    order = Window.partitionBy(*by).orderBy(value)
    same = Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count("*").over(same) - 1) / F.lit(2.0)


def guarded_corr(x: str | Column, y: str | Column, least_pairs: int = 3, least_var: float = 1e-24) -> Column:
    """Pearson correlation over rows where both are there; null for few pairs or constant columns."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    va, vb = F.var_pop(a), F.var_pop(b)
    ok = (F.count(a) >= least_pairs) & (va > least_var) & (vb > least_var)
    return F.when(ok, F.covar_pop(a, b) / F.sqrt(F.when(va > least_var, va) * F.when(vb > least_var, vb)))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by, rho``: Pearson correlation of average ranks over complete pairs."""
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ranked.select(*by, average_rank(by, x).alias("_x"), average_rank(by, y).alias("_y"))
    return ranked.groupBy(*by).agg(guarded_corr("_x", "_y", 2).alias("rho"))


def z_score(by: list[str], value: str, floor: float = 1e-12) -> Column:
    w = Window.partitionBy(*by)
    return (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + floor)


def equal_bin(c: str | Column, bins: int = 10) -> Column:
    """floor(bins * c), the last bin closed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")


def edge_bin(c: str | Column, bins: int = 10) -> Column:
    """Bin by explicit decimal edges, right-open, the last bin closed."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(bins - 1)
    for j in range(bins - 1, 0, -1):
        out = F.when(c < F.lit(j / bins), j - 1).otherwise(out)
    return out.cast("int")


def hash_rank(key: str | Column, seed: str = "20260914") -> Column:
    """0-based rank of distinct keys by sha256(seed|key), key: a fixed shuffle for folds and samples."""
    key = F.col(key) if isinstance(key, str) else key
    return F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), key), 256), key)) - 1
