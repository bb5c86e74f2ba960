"""Retrieval metrics: MRR, precision, recall, hit rate and NDCG at k, by query and as macro averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import gain
from .sparse import SparseIndex

METRICS = ("mrr", "precision", "recall", "hit_rate", "ndcg")


def by_query(samples: DataFrame, k: int) -> DataFrame:
    """samples (query_id, retrieved_ids array, ground_truth_ids array) -> one row a sample.

    Everything happens inside a row: no shuffle. Precision divides by k; recall by the distinct relevant ids, 0 if none.
    """
    truth = F.array_distinct("ground_truth_ids")
    top = F.slice("retrieved_ids", 1, max(k, 1))
    hit = F.transform(top, lambda x: F.array_contains(F.col("truth"), x))
    x = samples.withColumn("truth", truth).withColumn("hits", hit)
    n_hit, n_true = F.size(F.filter("hits", lambda h: h)), F.size("truth")
    first = F.array_position("hits", True)
    gained = F.aggregate(F.transform("hits", lambda h, i: F.when(h, gain(i)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    ideal = F.aggregate(F.sequence(F.lit(0), F.least(n_true, F.lit(k)) - 1), F.lit(0.0), lambda s, i: s + gain(i))
    zero = F.lit(k) <= 0
    return x.select(
        "query_id",
        F.when(zero | (first == 0), 0.0).otherwise(1 / first).alias("mrr"),
        F.when(zero, 0.0).otherwise(n_hit / F.lit(max(k, 1))).alias("precision"),
        F.when(zero | (n_true == 0), 0.0).otherwise(F.try_divide(n_hit, n_true)).alias("recall"),
        F.when(zero | (n_hit == 0), 0.0).otherwise(1.0).alias("hit_rate"),
        F.when(zero | (n_true == 0), 0.0).otherwise(gained / F.when(n_true > 0, ideal)).alias("ndcg"),
    )


def macro(samples: DataFrame, k: int) -> DataFrame:
    """One row: the averages, all 0 without samples."""
    return by_query(samples, k).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n_samples"))


def collect_ids(hits: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id, rank) -> (query_id, retrieved_ids)."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda h: h["doc_id"])
    return hits.groupBy("query_id").agg(ids.alias("retrieved_ids"))


def self_samples(docs: DataFrame, n: int = 10, words: int = 3) -> DataFrame:
    """The first words of the first documents as queries with their own id as truth: (query_id, text, ground_truth_ids)."""
    first = F.array_join(F.slice(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""), 1, words), " ")
    return docs.orderBy("doc_id").limit(n).select(F.col("doc_id").alias("query_id"), first.alias("text"), F.array("doc_id").alias("ground_truth_ids"))


def self_eval(docs: DataFrame, k: int, index: SparseIndex | None = None, n: int = 10) -> DataFrame:
    """Macro metrics of self_samples under sparse search, all queries in one job."""
    samples = self_samples(docs, n)
    found = collect_ids((index or SparseIndex.build(docs)).search(samples.select("query_id", "text"), k))
    none = F.array().cast(f"array<{dict(docs.dtypes)['doc_id']}>")
    return macro(samples.join(found, "query_id", "left").withColumn("retrieved_ids", F.coalesce("retrieved_ids", none)), k)
