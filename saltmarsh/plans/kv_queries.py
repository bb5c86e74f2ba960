"""Registered key-value queries: events as a change log (key user:{user_id}, an error event deletes), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kv as K
from ..operators import store as S
from ..session import table
from ..sources import documents as Src


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    gone = F.col("event_type") == "error"
    return e.select(F.col("event_id").alias("seq"), F.encode(key, "UTF-8").alias("key"), F.when(~gone, F.encode(F.col("value").cast("decimal(18,6)").cast("string"), "UTF-8")).alias("value"), gone.alias("is_delete"))


def _shown(df: DataFrame) -> DataFrame:
    names = {"key": F.decode("key", "UTF-8"), "value": F.decode("value", "UTF-8")}
    return df.select(*[names[c].alias(c) if c in names else F.col(c) for c in df.columns])


def _lit(text: str):
    return F.lit(bytearray(text.encode()))


def kv_latest(spark, sf):
    return _shown(K.latest(_log(spark, sf)))


def kv_range_scan(spark, sf):
    return _shown(K.scan(_log(spark, sf), _lit("user:00000010"), _lit("user:00000090")))


def kv_inverted_scan(spark, sf):
    return _shown(K.scan(_log(spark, sf), _lit("user:00000090"), _lit("user:00000010")))


def kv_prefix_scan(spark, sf):
    return _shown(K.prefix_scan(_log(spark, sf), _lit("user:0000001")))


def kv_reverse_limit(spark, sf):
    return _shown(K.scan(_log(spark, sf), limit=20, reverse=True))


def kv_point_get(spark, sf):
    return _shown(K.get(_log(spark, sf), _lit("user:00000042")))


def kv_merge_priority(spark, sf):
    log = K.latest(_log(spark, sf)).select("key", "value")
    other = table(spark, sf, "customer").select(F.encode(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")), "UTF-8").alias("key"), F.encode("c_name", "UTF-8").alias("value"))
    return _shown(K.merge_sources(other, log)).withColumn("src_idx", F.col("src_idx").cast("int"))


def kv_compacted(spark, sf):
    rows = K.compacted(_log(spark, sf), bottom=False)
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.count_if("is_delete").alias("tombstones"), F.max("seq").alias("last_seq"))


def kv_inspect(spark, sf):
    return K.inspect(_log(spark, sf))[0].select("entries", "tombstones", "values", F.decode("min_key", "UTF-8").alias("min_key"), F.decode("max_key", "UTF-8").alias("max_key"))


def _files(spark, sf):
    o = table(spark, sf, "orders")
    level = F.expr("cast(o_orderkey % 3 as int)")
    return o.groupBy(level.alias("level"), F.expr("o_custkey div 100").alias("file")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count(F.lit(1)).alias("rows"))


def kv_overlaps(spark, sf):
    """Files of level 0 with those of level 1 whose key ranges meet; catalogues are small, so the range join is broadcast."""
    f = _files(spark, sf)
    a, b = f.where("level = 0").select(F.col("file").alias("file0"), F.col("lo").alias("lo0"), F.col("hi").alias("hi0")), f.where("level = 1").select(F.col("file").alias("file1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    return a.join(b, K.overlaps(F.col("lo0"), F.col("hi0"), F.col("lo1"), F.col("hi1"))).select("file0", "file1")


def kv_level_stats(spark, sf):
    return _files(spark, sf).groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def kv_bloom(spark, sf):
    """Customers probed against the filter of the users seen: no user is missed, few others pass."""
    keys = table(spark, sf, "events").select(F.col("user_id").cast("string").cast("binary").alias("key")).distinct()
    bits, m, k = K.bloom_bits(keys)
    probes = keys.unionByName(table(spark, sf, "part").select((F.col("p_partkey") + 10_000_000).cast("string").cast("binary").alias("key")))
    return K.might_contain(probes, bits, m, k).join(keys.withColumn("known", F.lit(True)), "key", "left").agg(F.count_if("known").alias("found"), F.count_if(F.col("known").isNull()).alias("false_positives"))


def _versions(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    first = d.select("doc_id", F.lit(1).alias("version"), F.lit(False).alias("is_delete"), "text")
    second = l.select("doc_id", F.lit(2).alias("version"), (F.col("quality") == 0).alias("is_delete"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("text"))
    return first.unionByName(second)


def document_versions(spark, sf):
    return S.current(_versions(spark, sf)).select("doc_id", "version", F.length("text").cast("long").alias("n"))


def document_recovery(spark, sf):
    v = _versions(spark, sf)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("version"), "embedding")
    meta = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("version"), F.col("lang").alias("metadata"))
    chunks = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("version"), F.lit(0).alias("chunk_index"), F.lit("c").alias("chunk_id"), F.lit(0).alias("start_char"), F.lit(1).alias("end_char"), F.lit("t").alias("text"))
    return S.recover(v, vectors, meta, chunks).select("doc_id", "version", F.col("embedding").isNotNull().alias("has_vector"), "metadata", F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n_chunks"))


def batch_op_parse(spark, sf):
    lines = ["put a 1", "# note", "", '{"op": "set", "key": "b", "value": "2"}', '{"delete": {"key": "a"}}', "del b", "insert c three words here", '{"insert": {"key": "d", "value": "4"}}', "// end", "remove d"]
    return Src.parse_ops(spark.createDataFrame([(x,) for x in lines], "value string")).select("op", "key", "value")


QUERIES = {
    "kv_latest": kv_latest, "kv_range_scan": kv_range_scan, "kv_inverted_scan": kv_inverted_scan, "kv_prefix_scan": kv_prefix_scan, "kv_reverse_limit": kv_reverse_limit, "kv_point_get": kv_point_get,
    "kv_merge_priority": kv_merge_priority, "kv_compacted": kv_compacted, "kv_inspect": kv_inspect, "kv_overlaps": kv_overlaps, "kv_level_stats": kv_level_stats, "kv_bloom": kv_bloom,
    "document_versions": document_versions, "document_recovery": document_recovery, "batch_op_parse": batch_op_parse,
}

_LOG = "log AS (SELECT event_id AS seq, 'user:' || lpad(user_id::VARCHAR, 8, '0') AS key, CASE WHEN event_type <> 'error' THEN value::DECIMAL(18,6)::VARCHAR END AS value, event_type = 'error' AS is_delete FROM events)"
_NEW = f"{_LOG}, newest AS (SELECT key, arg_max({{'value': value, 'is_delete': is_delete}}, seq) AS v, max(seq) AS seq FROM log GROUP BY key), live AS (SELECT key, v.value AS value, seq FROM newest WHERE NOT v.is_delete)"
_VERSIONS = "v AS (SELECT doc_id, 1 AS version, false AS is_delete, text FROM documents UNION ALL SELECT doc_id, 2, quality = 0, 'quality ' || quality FROM labels), cur AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1)"
_FILES = "f AS (SELECT (o_orderkey % 3)::INT AS level, o_custkey // 100 AS file, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS rows FROM orders GROUP BY ALL)"

SQL = {
    "kv_latest": f"WITH {_NEW} SELECT key, value, seq FROM live",
    "kv_range_scan": f"WITH {_NEW} SELECT key, value FROM live WHERE key >= 'user:00000010' AND key < 'user:00000090'",
    "kv_inverted_scan": f"WITH {_NEW} SELECT key, value FROM live WHERE key >= 'user:00000090' AND key < 'user:00000010'",
    "kv_prefix_scan": f"WITH {_NEW} SELECT key, value FROM live WHERE starts_with(key, 'user:0000001')",
    "kv_reverse_limit": f"WITH {_NEW} SELECT key, value FROM live ORDER BY key DESC LIMIT 20",
    "kv_point_get": f"WITH {_NEW} SELECT key, value FROM live WHERE key = 'user:00000042'",
    "kv_merge_priority": f"WITH {_NEW}, u AS (SELECT 'user:' || lpad(c_custkey::VARCHAR, 8, '0') AS key, c_name AS value, 0 AS src_idx FROM customer UNION ALL SELECT key, value, 1 FROM live) SELECT key, arg_min(value, src_idx) AS value, min(src_idx)::INT AS src_idx FROM u GROUP BY key",
    "kv_compacted": f"WITH {_NEW} SELECT count(*) AS entries, count(*) FILTER (v.is_delete) AS tombstones, max(seq) AS last_seq FROM newest",
    "kv_inspect": f"WITH {_LOG} SELECT count(*) AS entries, count(*) FILTER (is_delete) AS tombstones, count(*) FILTER (NOT is_delete) AS values, min(key) AS min_key, max(key) AS max_key FROM log",
    "kv_overlaps": f"WITH {_FILES} SELECT a.file AS file0, b.file AS file1 FROM f a JOIN f b ON a.level = 0 AND b.level = 1 AND NOT (a.hi < b.lo OR b.hi < a.lo)",
    "kv_level_stats": f"WITH {_FILES} SELECT level, count(*) AS files, sum(rows)::BIGINT AS rows, min(lo) AS lo, max(hi) AS hi FROM f GROUP BY level",
    "document_versions": f"WITH {_VERSIONS} SELECT doc_id, version, length(text)::BIGINT AS n FROM cur WHERE NOT is_delete",
    "document_recovery": f"WITH {_VERSIONS} SELECT cur.doc_id, version, vec_id IS NOT NULL AS has_vector, lang AS metadata, CASE WHEN version = 1 THEN 1 ELSE 0 END::BIGINT AS n_chunks FROM cur LEFT JOIN embeddings ON vec_id = cur.doc_id LEFT JOIN documents d ON d.doc_id = cur.doc_id WHERE NOT is_delete",
    "batch_op_parse": "SELECT * FROM (VALUES ('put','a','1'), ('put','b','2'), ('delete','a',NULL), ('delete','b',NULL), ('put','c','three words here'), ('put','d','4'), ('delete','d',NULL)) t(op, key, value)",
}
