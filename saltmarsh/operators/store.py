"""Documents and entities over the change-log view: persist, load, recover, delete.

Tables are append-only with a version; the newest row of an id decides, and a deleted document takes its chunks and vector
with it. A new version replaces the old one whole, vector and chunks too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(docs: DataFrame) -> DataFrame:
    """docs (doc_id, version, is_delete, ...) -> the newest rows that are no deletes."""
    columns = [c for c in docs.columns if c != "doc_id"]
    newest = docs.groupBy("doc_id").agg(F.max_by(F.struct(*columns), "version").alias("d"))
    return newest.where(~F.col("d.is_delete")).select("doc_id", *[F.col(f"d.{c}").alias(c) for c in columns])


def tombstones(ids: DataFrame, docs: DataFrame, version: int) -> DataFrame:
    """Rows that delete those of ids (doc_id) that are there."""
    there = current(docs).join(ids, "doc_id", "left_semi").select("doc_id")
    rest = [F.lit(None).cast(t).alias(c) for c, t in docs.dtypes if c not in ("doc_id", "version", "is_delete")]
    return there.select("doc_id", F.lit(version).cast(dict(docs.dtypes)["version"]).alias("version"), F.lit(True).alias("is_delete"), *rest).select(docs.columns)


def with_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Current documents with their version's chunks in order."""
    parts = chunks.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "start_char", "end_char", "text"))).alias("chunks"))
    return current(docs).join(parts, ["doc_id", "version"], "left")


def recover(docs: DataFrame, vectors: DataFrame, meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every current document with text, with vector, metadata and chunks where there are any, by id."""
    x = with_chunks(docs.drop("embedding", "metadata"), chunks).where(F.col("text").isNotNull())
    newest = lambda df, c: df.groupBy("doc_id").agg(F.max_by(c, "version").alias(c))
    return x.join(newest(vectors, "embedding"), "doc_id", "left").join(newest(meta, "metadata"), "doc_id", "left").orderBy("doc_id")


def entities(log: DataFrame, prefix: str, schema: str) -> DataFrame:
    """Entities kept as JSON under keys with the prefix: (key, the schema's fields)."""
    from .kv import latest

    rows = latest(log.where(F.col("key").cast("string").startswith(prefix)))
    return rows.select(F.col("key").cast("string").alias("key"), F.from_json(F.col("value").cast("string"), schema).alias("e")).select("key", "e.*")
