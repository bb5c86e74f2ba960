"""BM25 and BM25+ over a batch of queries.

An index is one table of token lists, kept as a plan over the documents or written once with its postings (``write``). A
search reads it once: each document's tokens are cut down, in its own row, to those of the query terms, and the few
rows that are left are counted, weighed and added up per (query, document). Postings of other terms are neither built nor
shuffled. A written index has its postings in files by a hash of the term, so a search opens those of its terms only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..storage import written

#: Scores are rounded to this many digits, so that equal documents tie whatever the order of summation.
DIGITS = 9
#: Query terms of a batch are broadcast only up to this many rows; a larger batch is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Up to so many distinct query terms are looked for inside the rows, more are joined.
LITERAL_TERMS = 500
#: Folders of a written index's postings.
BUCKETS = 64


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows, else as it is (Catalyst then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@dataclass
class SparseIndex:
    """tokens: (doc_id, tokens). With ``folder`` the index was written there and is read from there."""

    tokens: DataFrame
    k1: float = 1.2
    b: float = 0.75
    delta: float = 0.0
    folder: str | None = None

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> "SparseIndex":
        return cls(docs.select(F.col(id_col).alias("doc_id"), T.tokens(F.col(text_col)).alias("tokens")), **options)

    def write(self, folder: str) -> "SparseIndex":
        """Tokens, postings by ``BUCKETS`` hashes of the term, sorted by term, and lengths."""
        self.tokens.write.parquet(f"{folder}/tokens")
        read = self.tokens.sparkSession.read.parquet
        own = replace(self, tokens=read(f"{folder}/tokens"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        own.postings.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(f"{folder}/postings")
        own.doc_stats.write.parquet(f"{folder}/lengths")
        return replace(own, folder=folder)

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf)."""
        if self.folder:
            return self.tokens.sparkSession.read.parquet(f"{self.folder}/postings").drop("bucket")
        return self.tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))

    @property
    def doc_stats(self) -> DataFrame:
        """(doc_id, dl)."""
        if self.folder:
            return self.tokens.sparkSession.read.parquet(f"{self.folder}/lengths")
        return self.tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "SparseIndex":
        """Upserts by document id."""
        new = SparseIndex.build(docs, id_col, text_col)
        old = self.remove(new.tokens.select("doc_id"))
        return replace(old, tokens=old.tokens.unionByName(new.tokens))

    def remove(self, ids: DataFrame) -> "SparseIndex":
        return replace(self, tokens=self.tokens.join(ids, "doc_id", "left_anti"), folder=None)

    def clear(self) -> "SparseIndex":
        return replace(self, tokens=self.tokens.limit(0), folder=None)

    def corpus(self) -> DataFrame:
        """One row: n_docs, avgdl (1 at least)."""
        return _corpus(self.doc_stats)

    def term_stats(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def _hits(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((term, doc_id, dl, tf) of the terms' postings, corpus)."""
        rows = terms.limit(LITERAL_TERMS + 1).collect()  # bounded: the words of a batch of queries
        words, few = [r.term for r in rows], len(rows) <= LITERAL_TERMS
        if self.folder:
            read = self.tokens.sparkSession.read.parquet(f"{self.folder}/postings")
            if few:
                buckets = [r.b for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
                read = read.where(F.col("bucket").isin(buckets) & F.col("term").isin(words))
            else:
                read = read.join(terms, "term", "left_semi")
            return read.drop("bucket").join(self.doc_stats, "doc_id"), self.corpus()
        if few:
            # One pass over the texts; what is written has a narrow row a document.
            own = F.filter("tokens", lambda t: t.isin(words)) if words else F.array().cast("array<string>")
            marked = written(self.tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"), own.alias("own")), "marked")
            hits = marked.where(F.size("own") > 0).select("doc_id", "dl", F.explode("own").alias("term"))
            return hits.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf")), _corpus(marked)
        lengths = written(self.doc_stats, "lengths")
        hits = self.tokens.select("doc_id", F.explode("tokens").alias("term")).join(checked_broadcast(terms), "term", "left_semi")
        return written(hits.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf")), "hits").join(lengths, "doc_id"), _corpus(lengths)

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of all documents with a query term. queries: query_id, text."""
        terms = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        hits, corpus = self._hits(terms.select("term").distinct())
        freq = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(corpus))  # one row
        idf = freq.select("term", V.idf(F.col("n_docs").cast("double"), F.col("df")).alias("idf"), "avgdl")
        scored = hits.join(terms.join(idf, "term"), "term")
        part = V.bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"), F.col("qtf"), self.k1, self.b, self.delta)
        return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), DIGITS).alias("score"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank); ties go to the smaller doc_id."""
        return top_k(self.scores(queries), k)


def _corpus(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.coalesce(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    best = Window.partitionBy(by).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
