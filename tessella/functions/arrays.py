"""Column functions over arrays of option scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def logsumexp(a: Column) -> Column:
    """Stable log of the sum of exponentials; null for an empty array."""
    top = F.array_max(a)
    return top + F.log(total(F.transform(a, lambda x: F.exp(x - top))))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    raw = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(raw, lambda x: x / total(raw))


def argmax_first(a: Column) -> Column:
    """0-based place of the largest entry; the lowest place among equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def without(a: Column, place: Column) -> Column:
    return F.filter(a, lambda x, i: i != place)


def entropy(p: Column) -> Column:
    """Natural entropy, with 0 log 0 = 0."""
    return total(F.transform(p, lambda x: F.when(x > 0, -x * F.log(x)).otherwise(F.lit(0.0))))


def sigmoid(x: Column, clip: float | None = None) -> Column:
    if clip is not None:
        x = F.least(F.greatest(x, F.lit(-clip)), F.lit(clip))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def finite(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def gold_log_odds(loglik: Column, gold: Column) -> Column:
    """Gold against the rest on raw scores; missing options are left out."""
    rest = F.filter(loglik, lambda x, i: (i != gold) & finite(x))
    return F.get(loglik, gold) - logsumexp(rest)
