"""Vector and scalar mathematics as Column expressions, in DOUBLE."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two lengths."""
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0, else within [-1, 1]."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.coalesce(F.pow(x.cast("double") - y.cast("double"), 2), F.lit(0.0)))))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """cosine, dot, or euclidean as 1 / (1 + distance)."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    if metric == "euclidean":
        return 1 / (1 + euclidean(a, b))
    raise ValueError(f"unknown metric {metric!r}")


def normalize(a: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    norm = l2_norm(a)
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def check_dim(a: Column, dim: int) -> Column:
    """The vector itself; the query fails if its length is another."""
    return F.when(F.size(a) == dim, a).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(a).cast("string"))))


def idf(n_docs: Column, doc_freq: Column) -> Column:
    return F.greatest(F.lit(0.0), F.ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5) + 1))


def bm25(tf: Column, dl: Column, avgdl: Column, idf_: Column, qtf: Column, k1: float = 1.2, b: float = 0.75, delta: float = 0.0) -> Column:
    saturated = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    return idf_ * (saturated + delta) * qtf


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def recency(age_seconds: Column, half_life: float = 3600.0, clamped: bool = True) -> Column:
    """1 for a time that is still to come; unclamped, such a time counts beyond 1."""
    age = F.greatest(age_seconds, F.lit(0)) if clamped else age_seconds
    decay = F.exp(-math.log(2) * age / max(half_life, 1.0))
    return clamp(decay) if clamped else decay


def workload(active: Column, most: int) -> Column:
    return clamp(1 - active / most) if most else F.lit(0.0)


def priority_tier(priority: Column, capability: Column) -> Column:
    """priority: 0 low, 1 medium, 2 high, 3 critical."""
    return (
        F.when(priority == 3, F.when(capability >= 0.99, 1.0).otherwise(0.2))
        .when(priority == 2, F.when(capability >= 0.75, 0.9).otherwise(0.4))
        .when(priority == 1, 0.6)
        .otherwise(0.5)
    )


def calculate(op: Column, a: Column, b: Column) -> Column:
    """add, sub, mul, div, pow, mod; null for another op and for a divisor that is nearly 0."""
    small = F.abs(b) < 2.220446049250313e-16
    safe = F.when(~small, b)
    return (
        F.when(op == "add", a + b).when(op == "sub", a - b).when(op == "mul", a * b).when(op == "div", F.try_divide(a, safe)).when(op == "pow", F.pow(a, b)).when(op == "mod", a % safe)
    )


def gain(position: Column) -> Column:
    """NDCG gain of a 0-based position."""
    return 1 / F.log2(position + 2)
