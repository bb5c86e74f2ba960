"""Operator 3: shards that each match the source mixture (proportional stratified interleaving). Native.

Rows are shuffled by a seeded key within their source; the row of rank r among n of its source gets the fractional
rank (r + 1/2) / n; all rows sorted by that are cut into shards whose counts are at most one apart. Any stretch of
the sorted rows holds every source in its proportion, so every shard does.

Ranks and positions come from windows inside ranges of the sorted rows (``bucketed.py``): ranges are even however hot a
source, an id or a group of copies is, and no task holds a whole source. Only ids, sizes and checksums are shuffled.

Defined results: a null text has size 8 and checksum 0, a null source is a source of its own, rows that repeat each
take their own slot (ties by doc_id, then text checksum; equal rows are interchangeable), an empty table gives no
rows, other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bucketed import group_key, ranges_for, running
from .common import hash_key, written

SHARDS, SEED = 24, "shards-1"


def interleave(df: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, source, shard, slot): law ``rows``, every shard has the mixture of the whole."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            group_key(F.col(source_col)).alias("src"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            hash_key(seed, F.col(id_col)).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    total = rows.count()
    n = ranges_for(total)
    ranked = running(rows, ["src"], ["key", "doc_id", "text_crc32", "row"], F.lit(1), "rank", n)
    counts = rows.groupBy("src").agg(F.count(F.lit(1)).alias("n_src"))
    placed = ranked.join(counts, "src").withColumn("at", (F.col("rank") + 0.5) / F.col("n_src"))
    position = running(placed, [], ["at", "src", "rank"], F.lit(1), "pos", n)
    # Shard s has the positions from ceil(s * total / shards) on.
    shard = F.expr(f"cast((pos * {shards}L) div {max(total, 1)}L as int)")
    start = F.expr(f"(cast((pos * {shards}L) div {max(total, 1)}L as bigint) * {total}L + {shards - 1}L) div {shards}L")
    return position.select("doc_id", "size", "text_crc32", "source", shard.alias("shard"), (F.col("pos") - start).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return interleave(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _nibbles() -> list[int]:
    found = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        found.append(c)
    return found


#: DuckDB has no crc32, so it is folded over the text's half bytes, the lower one first.
SQL = f"""
WITH texts AS (SELECT DISTINCT coalesce(text, '') AS x FROM documents),
digits AS (SELECT x, hex(encode(x)) AS h FROM texts),
halves AS (SELECT x, [4294967295::BIGINT] || list_transform(range(1, length(h) + 1), lambda i: (instr('0123456789ABCDEF', h[(i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)::INT]) - 1)::BIGINT) AS b FROM digits),
crc AS MATERIALIZED (SELECT x, xor(list_reduce(b, lambda c, d: xor(list_extract({_nibbles()}, ((xor(c, d) & 15) + 1)::BIGINT), c >> 4)), 4294967295)::BIGINT AS text_crc32 FROM halves),
pre AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, coalesce(text, '') AS x,
  ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM pre),
placed AS (SELECT *, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n, source NULLS LAST, r) - 1 AS pos, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (pos * {SHARDS} // total)::INT AS shard,
  (pos - ((pos * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard FROM placed JOIN crc USING (x)
"""
