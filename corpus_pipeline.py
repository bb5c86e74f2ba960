"""From raw documents to token ids: toxicity, near duplicates, secrets, source mixture, BPE.

Each stage takes all rows that the one before kept; all but the last return the columns of documents. Models and lexica
are fitted on the stage's own input. Other columns are left out, whatever their names; texts of any length are taken whole;
an empty table gives an empty one. Of rows with nulls, empty texts and repeats:

- toxicity: a null or empty text scores 0 and stays; repeated rows score alike, so all stay or go.
- near duplicates: null and empty texts are near copies of each other; repeated rows leave one; of ties the smallest row stays.
- secrets: a null text stays null; no row goes.
- mixture: each row is counted by itself; null and blank texts stay once.
- bpe: a null text has no ids; each row gives a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import bpe, mixing, secrets, shingles, toxicity
from saltmarsh.llm.common import discard, slices, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with(docs: DataFrame, function: Callable[[list[str | None]], list], column: str, kind: str) -> DataFrame:
    """docs with one more column, a function of the texts; the rows stay where they are, so nothing is shuffled."""
    docs = docs.select(COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array(function(batch.column(1).to_pylist()), pa.string() if kind == "string" else pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*COLUMNS, column])

    return docs.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in docs.dtypes), f"{column} {kind}"]))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.7 or more."""
    model = spark.sparkContext.broadcast(toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = _with(docs, lambda texts: [model.value.score(t)[0] for t in texts], "toxicity", "double")
    return scored.where(F.col("toxicity") < toxicity.THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts that share 0.8 of their five-word shingles, found by operator 2's SimHash and
    BK-trees and checked on the exact sets: the smallest id, rows without an id last, then the smallest hash of the text."""
    rows, found = shingles.near_copies(docs.select(COLUMNS))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row")
    ranked = written(rows.select("row", order.alias("order")).join(found, "row"), "ranked")
    kept = ranked.groupBy("root").agg(F.min("order").alias("least"), F.count(F.lit(1)).alias("n"))
    gone = written(ranked.join(kept.where("n > 1"), "root").where(F.col("order") != F.col("least")).select("row"), "gone")
    discard(found, ranked)
    return rows.join(shingles.few(gone), "row", "left_anti").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each secret replaced by its kind in brackets; n_chars follows a changed text."""
    clean = _with(docs, lambda texts: [secrets.redact(t, f) if t and (f := secrets.spans(t)) else t for t in texts], "clean", "string")
    n_chars = F.when(F.col("clean").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("clean").cast("long"))
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it, whatever its id: a row without an id or of a repeated id counts by itself.
    The row at a source's cut is kept whole; a null or blank text, which has no words to mix, stays once."""
    return mixing.repeated(docs.select(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row."""
    return bpe.encode(docs, lexicon=bpe.fit(docs), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixture", mix_sources), ("bpe", encode)]

#: The toxicity model is trained by gradient descent, fingerprints need XXH64 and ids need merges: no SQL for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
