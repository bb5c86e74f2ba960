"""Rank fusion of a dense and a sparse result, per query.

Inputs: (query_id, doc_id, score). Lists are joined by union and one aggregation, so a fusion is one shuffle on
(query_id, doc_id) after the windows over query_id. Ties go to the smaller doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import clamp
from .sparse import DIGITS, top_k

RRF_K, ALPHA = 60.0, 0.5


def _query() -> Window:
    return Window.partitionBy("query_id", "source")


def _both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    # A union of sides that are both partitioned by query takes over their partitioning, which adaptive execution may have
    # changed for one of them by then (it fails in Spark 4.1); a generated row carries none.
    row = lambda name: F.struct("query_id", "doc_id", F.col("score").cast("double").alias("score"), F.lit(name).alias("source"))
    pick = lambda df, name: df.select(F.inline(F.array(row(name))))
    return pick(dense, "dense").unionByName(pick(sparse, "sparse"))


def _rank() -> Column:
    return F.row_number().over(_query().orderBy(F.desc("score"), "doc_id"))


def _fused(rows: DataFrame, part: Column, k: int | None) -> DataFrame:
    of = lambda name: F.max(F.when(F.col("source") == name, F.col("score"))).alias(f"{name}_score")
    found = rows.withColumn("part", part).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"), of("dense"), of("sparse"))
    return top_k(found, k) if k is not None else found


def reciprocal_rank(dense: DataFrame, sparse: DataFrame, k: int | None = None, rrf_k: float = RRF_K) -> DataFrame:
    """Sum of 1 / (rrf_k + rank), ranks from 1."""
    return _fused(_both(dense, sparse).withColumn("r", _rank()), 1 / (F.lit(float(rrf_k)) + F.col("r")), k)


def min_max(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows with ``normalized``: (score - min) / (max - min), 1 where the range is below 1e-6."""
    w = Window.partitionBy(*(by or ["query_id"]))
    low, high = F.min("score").over(w), F.max("score").over(w)
    return rows.withColumn("normalized", F.when(high - low < 1e-6, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def z_score(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows with ``normalized``: deviation from the mean in population standard deviations, 0 where that is below 1e-6."""
    w = Window.partitionBy(*(by or ["query_id"]))
    mean, sd = F.avg("score").over(w), F.stddev_pop("score").over(w)
    return rows.withColumn("normalized", F.when(sd < 1e-6, F.lit(0.0)).otherwise((F.col("score") - mean) / sd))


def weighted(dense: DataFrame, sparse: DataFrame, alpha: float = ALPHA, k: int | None = None) -> DataFrame:
    """alpha of the dense list and 1 - alpha of the sparse one, each scaled to [0, 1]; a missing side counts 0."""
    a = min(1.0, max(0.0, alpha))
    rows = min_max(_both(dense, sparse), ["query_id", "source"])
    return _fused(rows, F.col("normalized") * F.when(F.col("source") == "dense", a).otherwise(1 - a), k)


def borda(dense: DataFrame, sparse: DataFrame, k: int | None = None) -> DataFrame:
    """Sum of (list length - rank from 0)."""
    rows = _both(dense, sparse).withColumns({"r": _rank(), "n": F.count(F.lit(1)).over(_query())})
    return _fused(rows, (F.col("n") - F.col("r") + 1).cast("double"), k)


def fuse(dense: DataFrame | None, sparse: DataFrame | None, strategy: str = "rrf", k: int | None = None, rrf_k: float = RRF_K, alpha: float = ALPHA) -> DataFrame:
    """rrf, weighted, borda, dense or sparse. A side that is None passes the other through with its raw scores; so does,
    query by query, a side without rows for the query (rrf and weighted)."""
    if strategy == "dense" or sparse is None:
        return _alone(dense, "dense", k)
    if strategy == "sparse" or dense is None:
        return _alone(sparse, "sparse", k)
    found = {"rrf": lambda: reciprocal_rank(dense, sparse, None, rrf_k), "weighted": lambda: weighted(dense, sparse, alpha, None), "borda": lambda: borda(dense, sparse, None)}[strategy]()
    if strategy != "borda":
        w = Window.partitionBy("query_id")
        n_dense, n_sparse = F.count("dense_score").over(w), F.count("sparse_score").over(w)
        found = found.withColumn("score", F.when(n_sparse == 0, F.col("dense_score")).when(n_dense == 0, F.col("sparse_score")).otherwise(F.col("score")))
    return top_k(found, k) if k is not None else found


def _alone(rows: DataFrame, name: str, k: int | None) -> DataFrame:
    other = "sparse" if name == "dense" else "dense"
    found = rows.select("query_id", "doc_id", F.col("score").cast("double").alias("score"), F.col("score").cast("double").alias(f"{name}_score"), F.lit(None).cast("double").alias(f"{other}_score"))
    found = found.select("query_id", "doc_id", "score", "dense_score", "sparse_score")
    return top_k(found, k) if k is not None else found


def at_least(rows: DataFrame, score: float) -> DataFrame:
    return rows.where(F.col("score") >= score)


__all__ = ["reciprocal_rank", "weighted", "borda", "fuse", "min_max", "z_score", "at_least", "clamp"]
