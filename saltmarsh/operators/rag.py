"""The engine as a store in a folder: ingest, delete and query with a semantic cache, context and prompt.

Tables are append-only batches, ``documents/version=n`` and ``chunks/version=n``; a batch counts once its documents are
written (chunks come first). The newest row of an id decides, so a new text replaces vector and chunks too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import written
from . import cache as C
from . import context as Cx
from . import store as S
from .chunk import ChunkConfig, chunk
from .embed import embed
from .retrieve import HybridEngine, RagQuery

#: Ids with several rows in the log, or deleted, that are broadcast at most.
MIXED = 1_000_000
RESULTS = "array<struct<doc_id:bigint,score:double,rank:int>>"


def hashed(rows: DataFrame) -> DataFrame:
    """Rows with a hashed embedding of their text."""
    return embed(rows, 64)


@dataclass
class Rag:
    """docs: doc_id long, text, and the same metadata columns in every batch."""

    spark: SparkSession
    folder: str
    embedder: Callable[[DataFrame], DataFrame] | None = hashed
    chunking: ChunkConfig = ChunkConfig()
    cache: C.CacheConfig = C.CacheConfig()
    context: Cx.ContextConfig = Cx.ContextConfig()
    entries: DataFrame | None = None
    hits: int = 0
    misses: int = 0

    def _next(self) -> int:
        return max(self.versions(), default=0) + 1

    def versions(self) -> list[int]:
        """Committed batches, from the folder's names."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/documents")
        system = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath() for s in system.listStatus(at)] if system.exists(at) else []
        return sorted(int(p.getName().partition("=")[2]) for p in names if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def log(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.option("basePath", f"{self.folder}/documents").parquet(*[f"{self.folder}/documents/version={v}" for v in found]) if found else None

    def documents(self) -> DataFrame:
        """Current documents with their vectors. Rows that are alone under their id are taken as they lie; only those that others
        replace are shuffled, unless they are too many to broadcast their ids."""
        if (log := self.log()) is None:
            raise ValueError("nothing was ingested")
        rows = log.select("doc_id", "version", "is_delete").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("is_delete", "version").alias("gone"))
        mixed = written(rows.where("n > 1 OR gone OR doc_id IS NULL"), "mixed")
        if mixed.count() > MIXED or not mixed.where("doc_id IS NULL").isEmpty():
            return S.current(log).drop("is_delete", "version")
        alone = log.join(F.broadcast(mixed.select("doc_id")), "doc_id", "left_anti") if not mixed.isEmpty() else log
        newer = mixed.where("NOT gone").select("doc_id")
        if not newer.isEmpty():
            alone = alone.unionByName(S.current(log.join(F.broadcast(newer), "doc_id", "left_semi")))
        return alone.drop("is_delete", "version")

    def chunks(self) -> DataFrame:
        """Chunks of the current versions."""
        found = self.spark.read.option("basePath", f"{self.folder}/chunks").parquet(*[f"{self.folder}/chunks/version={v}" for v in self.versions() if v in self._chunked()])
        return found.join(S.current(self.log()).select("doc_id", "version"), ["doc_id", "version"], "left_semi")

    def _chunked(self) -> set[int]:
        log = self.log()
        return {r.version for r in log.where(~F.col("is_delete")).select("version").distinct().collect()}

    def ingest(self, docs: DataFrame) -> dict:
        """Embeds, chunks and stores a batch, replacing documents of the same ids; {documents, chunks, bytes}."""
        version = self._next()
        rows = docs if self.embedder is None or "embedding" in docs.columns else self.embedder(docs)
        meta = [c for c in docs.columns if c not in ("doc_id", "text", "embedding")]
        parts = chunk(docs, self.chunking, keep=tuple(meta)).where(F.col("doc_id").isNotNull())
        (self.embedder(parts) if self.embedder is not None else parts).write.mode("overwrite").parquet(f"{self.folder}/chunks/version={version}")
        rows.withColumn("is_delete", F.lit(False)).write.mode("overwrite").parquet(f"{self.folder}/documents/version={version}")
        self._forget(docs.select("doc_id"))
        one = docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
        return {"documents": one.documents, "bytes": one["bytes"], "chunks": self.spark.read.parquet(f"{self.folder}/chunks/version={version}").count()}

    def delete(self, ids: DataFrame) -> int:
        """Deletes those of ids (doc_id) that are there, with their chunks, vectors and cached answers; returns how many."""
        if (log := self.log()) is None:
            return 0
        version = self._next()
        gone = S.tombstones(ids, log, version).drop("version")
        gone.write.mode("overwrite").parquet(f"{self.folder}/documents/version={version}")
        self._forget(ids)
        return self.spark.read.parquet(f"{self.folder}/documents/version={version}").count()

    def _forget(self, ids: DataFrame) -> None:
        if self.entries is not None:
            self.entries = written(C.invalidate(self.entries, ids), "cache")

    def engine(self) -> HybridEngine:
        docs = self.documents()
        vectors = docs.where(F.col("embedding").isNotNull()).select("doc_id", "embedding") if "embedding" in docs.columns else None
        return HybridEngine(docs.drop("embedding"), vectors)

    def query(self, queries: DataFrame, spec: RagQuery = RagQuery(rerank=True), now: int = 0) -> DataFrame:
        """queries (query_id, text, maybe embedding) -> (query_id, doc_id, score, rank, cached).

        A query that is similar enough to a live cache entry takes its results, without search or reranking; the others are
        searched and become entries. With a condition, or without embeddings, the cache is left aside.
        """
        if "embedding" not in queries.columns and self.embedder is not None:
            queries = self.embedder(queries)
        queries = written(queries, "queries")
        usable = spec.condition is None and "embedding" in queries.columns and spec.top_k > 0
        empty = queries.select("query_id").limit(0).selectExpr("query_id", "cast(null as string) AS entry_id", f"cast(null as {RESULTS}) AS results")
        found = written(C.lookup(self.entries, queries, F.lit(now), self.cache).select("query_id", "entry_id", "results"), "hits") if usable and self.entries is not None else empty
        asked = queries.join(found.select("query_id"), "query_id", "left_anti")
        searched = written(self.engine().query(asked, replace(spec, rerank_top_k=spec.rerank_top_k or spec.top_k)).select("query_id", F.col("doc_id").cast("long").alias("doc_id"), "score", "rank"), "searched")
        n_hits, n = found.count(), queries.count()
        self.hits, self.misses = self.hits + n_hits, self.misses + n - n_hits
        if usable:
            results = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))
            listed = searched.groupBy("query_id").agg(F.transform(results, lambda r: F.struct(r["doc_id"].alias("doc_id"), r["score"].alias("score"), r["rank"].alias("rank"))).cast(RESULTS).alias("results"))
            new = asked.join(listed, "query_id").select(F.concat_ws(":", F.lit(now), "query_id").alias("entry_id"), F.col("text").alias("query"), "embedding", "results", F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("last_accessed"))
            old = C.touch(self.entries, found, F.lit(now).cast("long")) if self.entries is not None else new.limit(0)
            self.entries = written(C.insert(old, new, F.lit(now), self.cache), "cache")
        cached = found.select("query_id", F.explode("results").alias("r")).select("query_id", "r.doc_id", "r.score", "r.rank", F.lit(True).alias("cached")).where(F.col("rank") <= max(spec.top_k, 0))
        return searched.withColumn("cached", F.lit(False)).unionByName(cached)

    def answer(self, queries: DataFrame, spec: RagQuery = RagQuery(rerank=True), now: int = 0, instruction: str = "Answer from the passages.") -> DataFrame:
        """(query_id, context, citations, doc_count, total_chars, was_truncated, prompt): embed, query, assemble, prompt."""
        docs, found = self.documents(), self.query(queries, spec, now)
        column = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
        hits = found.join(docs.select("doc_id", "text", column("source"), column("category"), column("url")), "doc_id")
        made = Cx.assemble(hits, self.context).join(queries.select("query_id", F.col("text").alias("question")), "query_id")
        return made.withColumn("prompt", T.prompt(instruction, F.col("context"), F.col("question"))).drop("question")

    def stats(self) -> dict:
        entries = self.entries.count() if self.entries is not None else 0
        return {"versions": len(self.versions()), "documents": self.documents().count() if self.versions() else 0, "cache": C.stats(self.hits, self.misses, entries)}
