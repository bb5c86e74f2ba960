"""The hybrid query over a batch of queries: one lazy plan from text to ranked documents."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import dense as D
from . import fusion as Fu
from . import rerank as R
from .sparse import SparseIndex, checked_broadcast, top_k


@dataclass
class RagQuery:
    """What a batch of queries asks for."""

    top_k: int = 10
    strategy: str = "rrf"
    rrf_k: float = 60.0
    alpha: float = 0.5
    metric: str = "cosine"
    condition: Column | None = None
    prefilter: bool = False
    min_score: float | None = None
    rerank: bool = False
    rerank_alpha: float = 0.7
    rerank_top_k: int | None = None
    mmr_lambda: float | None = None
    extra: dict = field(default_factory=dict)


@dataclass
class HybridEngine:
    """documents (doc_id, text, ...metadata) and vectors (doc_id, embedding); either may be left out of a search."""

    documents: DataFrame
    vectors: DataFrame | None = None
    index: SparseIndex | None = None

    def __post_init__(self):
        if self.index is None:
            self.index = SparseIndex.build(self.documents)

    def search(self, queries: DataFrame, top_k_: int = 10, rrf_k: float = 60.0, alpha: float = 0.5) -> DataFrame:
        """The plain form: twice top_k from each side, reciprocal ranks if rrf_k > 0, else weighted."""
        sparse = self.index.search(queries, 2 * top_k_) if "text" in queries.columns else None
        dense = self._dense(queries, 2 * top_k_, "cosine")
        return Fu.fuse(dense, sparse, "rrf" if rrf_k > 0 else "weighted", top_k_, rrf_k, alpha)

    def _dense(self, queries: DataFrame, k: int, metric: str) -> DataFrame | None:
        if self.vectors is None or "embedding" not in queries.columns:
            return None
        return D.search(self.vectors, queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding"), k, metric, id_col="doc_id")

    def query(self, queries: DataFrame, spec: RagQuery) -> DataFrame:
        """(query_id, doc_id, score, rank, dense_score, sparse_score, and the documents' columns).

        Three times top_k candidates of each side are fused; the condition applies to those candidates only (with
        ``prefilter`` to the documents before the search); then MMR, else reranking, else neither; then order, min_score
        and the final cut.
        """
        if spec.top_k <= 0:  # an empty result of the same columns
            return self.query(queries.limit(0), dataclasses.replace(spec, top_k=1))
        engine, wide = self, 3 * spec.top_k
        if spec.prefilter and spec.condition is not None:
            docs = self.documents.where(spec.condition)
            vectors = self.vectors.join(docs.select("doc_id"), "doc_id", "left_semi") if self.vectors is not None else None
            engine = HybridEngine(docs, vectors)
        sparse = engine.index.search(queries.select("query_id", "text"), wide) if spec.strategy != "dense" else None
        dense = engine._dense(queries, wide, spec.metric) if spec.strategy != "sparse" else None
        fused = Fu.fuse(dense, sparse, spec.strategy, wide, spec.rrf_k, spec.alpha).drop("rank")
        # The documents of a batch's hits are few: their texts aren't shuffled with all others.
        fused = written(fused, "fused")
        own = checked_broadcast(fused.select("doc_id").distinct())
        hits = fused.join(engine.documents.join(own, "doc_id", "left_semi"), "doc_id", "left")
        if spec.condition is not None and not spec.prefilter:
            hits = hits.where(spec.condition)
        if spec.mmr_lambda is not None:
            c = hits.join(self.vectors.select("doc_id", "embedding"), "doc_id", "left").join(queries.select("query_id", F.col("embedding").alias("query_embedding")), "query_id")
            new = R.mmr(c, spec.top_k, spec.mmr_lambda).select("query_id", "doc_id", F.col("mmr_score").alias("new_score"))
            hits = hits.join(new, ["query_id", "doc_id"]).withColumn("score", F.col("new_score")).drop("new_score")
        elif spec.rerank:
            c = hits.where(F.col("text").isNotNull()).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
            new = R.rerank(c, spec.rerank_top_k or spec.top_k, spec.rerank_alpha)
            hits = new.withColumn("score", F.col("reranked_score")).select(*hits.columns)
        if spec.min_score is not None:
            hits = Fu.at_least(hits, spec.min_score)
        return top_k(hits, spec.top_k)
