"""Agent memory: a latest-wins blackboard and episodes recalled by relevance, recency and importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from .sparse import top_k

WEIGHTS, HALF_LIFE = (0.5, 0.3, 0.2), 3600.0
#: Queries that are broadcast at once.
TURN = 1_000


def blackboard(log: DataFrame) -> DataFrame:
    """log (key, value, seq, is_delete) -> the current (key, value)."""
    newest = log.groupBy("key").agg(F.max_by(F.struct("value", "is_delete"), "seq").alias("v"))
    return newest.where(~F.col("v.is_delete")).select("key", "v.value")


def newest(episodes: DataFrame, capacity: int) -> DataFrame:
    """The latest ``capacity`` episodes of each agent, 10 at least; ties go to the larger id."""
    w = Window.partitionBy("agent_id").orderBy(F.desc("timestamp"), F.desc("id"))
    return episodes.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(10, capacity)).drop("n")


def of_agent(episodes: DataFrame, agent: str) -> DataFrame:
    return episodes.where(F.col("agent_id") == agent)


def of_task(episodes: DataFrame, task: str) -> DataFrame:
    return episodes.where(F.col("task_id") == task)


def with_tag(episodes: DataFrame, tag: str) -> DataFrame:
    return episodes.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))


def recall(episodes: DataFrame, queries: DataFrame, now: Column, k: int, weights: tuple = WEIGHTS, half_life: float = HALF_LIFE, clamped: bool = True) -> DataFrame:
    """queries (query_id, text, and embedding if there is one) -> the k best episodes of each, with all partial scores.

    Relevance is the cosine (0 at least) where both sides have a vector, else the word overlap. Queries are broadcast in turns;
    episodes stream past them, their words worked out once for all queries of a turn. An episode later than now is as recent
    as one of now; unclamped, it is more recent.
    """
    vector = F.col("q_embedding") if "embedding" in queries.columns else F.lit(None).cast("array<double>")
    q = queries.select("query_id", F.col("text").alias("q_text"), *([F.col("embedding").alias("q_embedding")] if "embedding" in queries.columns else []))
    q = q.withColumn("q_words", F.array_distinct(T.words(F.col("q_text"))))
    turns, found = max(1, -(-q.count() // TURN)), None
    own = F.col("embedding") if "embedding" in episodes.columns else F.lit(None).cast("array<double>")
    relevance = F.when(vector.isNotNull() & own.isNotNull(), F.greatest(F.lit(0.0), V.cosine(vector, own))).otherwise(T.overlap_of_words(F.col("q_words"), F.col("c_words"), F.col("c_low")))
    a, b, c = weights
    parted = episodes.withColumn("c_words", F.array_distinct(T.words(F.col("content")))).withColumn("c_low", F.array_distinct(F.transform("c_words", F.lower)))
    for t in range(turns):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == t) if turns > 1 else q
        x = parted.join(F.broadcast(part), F.lit(True)).withColumns({"relevance": relevance, "recency": V.recency(now - F.col("timestamp"), half_life, clamped)})
        x = top_k(x.withColumn("score", F.col("relevance") * a + F.col("recency") * b + F.col("importance") * c), k, id_col="id")
        found = x if found is None else found.unionByName(x)
    return found.select("query_id", "rank", "id", "score", "relevance", "recency", "importance")
