"""Reranking: lexical cross-encoder scores, weighted reranking, maximal marginal relevance.

The cross-encoder is an Arrow function over the pairs, one pass without a shuffle. MMR is a greedy sequence, so each query's candidates (three times
top_k at most) go to one grouped pandas function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from .arrow import sized

WEIGHTS = (0.5, 0.3, 0.2)
ALPHA = 0.7


PARTS = ("token_coverage", "phrase_match", "proximity", "combined_score")


def score_pair(q: list[str], d: list[str], weights: tuple[float, float, float] = WEIGHTS) -> tuple[float, float, float, float]:
    """(coverage, phrase, proximity, combined) of the tokens of a query and of a document.

    Coverage counts the query's tokens with repeats; phrase is the share of its bigrams that the document has, coverage for
    a single token; proximity is the number of matched query tokens over the stretch of the document that they span, 1
    for a single one. An empty side gives zeros.
    """
    if not q or not d:
        return 0.0, 0.0, 0.0, 0.0
    in_doc, in_query = set(d), set(q)
    matched = sum(t in in_doc for t in q)
    coverage = matched / len(q)
    if len(q) == 1:
        phrase = coverage
    elif len(d) < 2:
        phrase = 0.0
    else:
        have = set(zip(d, d[1:]))
        phrase = sum(g in have for g in zip(q, q[1:])) / (len(q) - 1)
    hits = [i for i, t in enumerate(d) if t in in_query]
    proximity = 0.0 if not hits else min(1.0, matched / (hits[-1] - hits[0] + 1)) if matched > 1 else 1.0
    return coverage, phrase, proximity, coverage * weights[0] + phrase * weights[1] + proximity * weights[2]


def explained(pairs: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """pairs (query, text, ...) with the four scores. One pass over the pairs in Arrow batches, without a shuffle; the
    token arrays come from the same expressions as everywhere else and are unpacked some megabytes at a time."""
    kept = pairs.drop(*PARTS)
    schema = StructType([*kept.schema.fields, *[StructField(p, DoubleType()) for p in PARTS]])
    return _scored(kept.select("*", T.tokens(F.col("query")).alias("__q"), T.tokens(F.col("text")).alias("__d")), schema, weights)


def _scored(rows: DataFrame, schema: StructType, weights: tuple[float, float, float]) -> DataFrame:
    """rows (..., tokens of the query, tokens of the text) with the four scores in place of the tokens."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, -1):
            q, d = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            found = [score_pair(x, y, weights) for x, y in zip(q, d)]
            new = [pa.array([f[k] for f in found], pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], names)

    return rows.mapInArrow(run, schema)


def explain(pairs: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """pairs (query_id, doc_id, query, text) -> (query_id, doc_id, and the four scores)."""
    kept = pairs.select("query_id", "doc_id")
    schema = StructType([*kept.schema.fields, *[StructField(p, DoubleType()) for p in PARTS]])
    return _scored(pairs.select("query_id", "doc_id", T.tokens(F.col("query")).alias("__q"), T.tokens(F.col("text")).alias("__d")), schema, weights)


def rerank(candidates: DataFrame, k: int, alpha: float = ALPHA, scores: DataFrame | None = None) -> DataFrame:
    """candidates (query_id, doc_id, query, text, score, ...) by alpha * cross-encoder + (1 - alpha) * score.

    ``scores`` (query_id, doc_id, combined_score) replaces the built-in scorer by a user's model. Adds new_rank and
    rank_delta (initial - new); ties keep the initial order.
    """
    a = min(1.0, max(0.0, alpha))
    x = explained(candidates) if scores is None else candidates.join(scores, ["query_id", "doc_id"])
    initial = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    x = x.withColumn("initial_rank", F.row_number().over(initial))
    x = x.withColumn("original_score", F.col("score").cast("double")).withColumn("reranked_score", F.col("combined_score") * a + F.col("original_score") * (1 - a))
    new = Window.partitionBy("query_id").orderBy(F.desc("reranked_score"), "initial_rank")
    x = x.withColumn("new_rank", F.row_number().over(new)).withColumn("rank_delta", F.col("initial_rank") - F.col("new_rank"))
    return x.where(F.col("new_rank") <= k).drop("score")


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.sqrt((a * a).sum() * (b * b).sum())
    return float(np.clip((a * b).sum() / n, -1, 1)) if n > 0 else 0.0


def mmr_order(query: np.ndarray, vectors: list[np.ndarray], scores: list[float], lam: float, k: int) -> list[tuple[int, float]]:
    """(candidate, mmr score) in picking order. A picked candidate's place is taken by the last one, which decides later ties."""
    lam = min(1.0, max(0.0, lam))
    rel = [s if not len(query) or not len(v) else 0.7 * _cosine(query, v) + 0.3 * s for v, s in zip(vectors, scores)]
    left, picked, most = list(range(len(vectors))), [], [0.0] * len(vectors)
    while len(picked) < k and left:
        best, at = -np.inf, 0
        for pos, i in enumerate(left):
            value = lam * rel[i] - (1 - lam) * most[i]
            if value > best:
                best, at = value, pos
        i = left[at]
        left[at] = left[-1]
        left.pop()
        for j in left:
            sim = _cosine(vectors[j], vectors[i])
            most[j] = max(most[j], sim) if picked else sim
        picked.append((i, float(best)))
    return picked


def mmr(candidates: DataFrame, k: int, lam: float = 0.5) -> DataFrame:
    """candidates (query_id, doc_id, score, embedding, query_embedding) -> k of each query, with mmr_score, new_rank (in
    picking order) and rank_delta."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        as_array = lambda v: np.asarray(v if v is not None else [], float)
        vectors = [as_array(v) for v in pdf["embedding"]]
        picked = mmr_order(as_array(pdf["query_embedding"][0]), vectors, pdf["score"].tolist(), lam, k)
        rows = [(pdf["query_id"][0], pdf["doc_id"][i], pdf["score"][i], s, n + 1, i - n) for n, (i, s) in enumerate(picked)]
        return pd.DataFrame(rows, columns=["query_id", "doc_id", "original_score", "mmr_score", "new_rank", "rank_delta"])

    kinds = dict(candidates.dtypes)
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, original_score double, mmr_score double, new_rank int, rank_delta int"
    rows = candidates.select("query_id", "doc_id", F.col("score").cast("double").alias("score"), "embedding", "query_embedding")
    return rows.groupBy("query_id").applyInPandas(run, schema)


__all__ = ["explain", "explained", "rerank", "mmr", "mmr_order"]
