"""Embedders: feature hashing of words, lookup tables, and the slot for a user's model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, 0xFFFFFFFFFFFFFFFF


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & MASK
    return h


WORDS = re.compile(r"[^\W_]+")


@lru_cache(200_000)
def hashed(word: str) -> tuple[int, float]:
    """(hash of the word in lower case, signed weight by its bytes)."""
    h = fnv1a(word.lower().encode())
    weight = 1 + min(len(word.encode()), 5) * 0.2
    return h, -weight if h >> 32 & 1 else weight


def hash_embedding(text: str | None, dim: int) -> list[float]:
    """Runs of letters and digits: bucket by the hash of the lower-case word, sign by bit 32, weight by bytes and position;
    normalised. Without words, or if all cancel out, the first unit vector."""
    found = list(map(hashed, WORDS.findall(text or "")))
    at = np.array([h % dim for h, _ in found], np.int64)
    v = np.bincount(at, np.array([w for _, w in found]) / (1 + 0.05 * np.arange(len(found))), dim) if found else np.zeros(dim)
    norm = np.sqrt((v * v).sum())
    if norm <= 1e-6:
        v[0], norm = 1.0, 1.0
    return (v / norm).tolist()


def embed(df: DataFrame, dim: int = 64, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """df with the hashed embedding; hashing wraps at 64 bits, which ANSI arithmetic doesn't, hence Arrow."""
    schema = df.drop(out).schema
    names = [f.name for f in schema.fields]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [hash_embedding(t, dim) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*names, out])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return df.drop(out).mapInArrow(run, StructType([*schema.fields, StructField(out, ArrayType(DoubleType()))]))


def lookup(df: DataFrame, table: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Embeddings from a table (text, embedding); a text that isn't in it fails the query."""
    found = df.join(table.select(F.col("text").alias("__text"), F.col("embedding").alias("__v")), F.col(text_col) == F.col("__text"), "left")
    missing = F.raise_error(F.concat(F.lit("no embedding for: "), F.coalesce(F.col(text_col), F.lit("null")))).cast("array<double>")
    return found.withColumn(out, F.coalesce("__v", missing)).drop("__text", "__v")
