"""Roll-ups of workflow events.

Events: kind (task_submitted, task_started, task_completed, task_failed, tool_called, routed, reflected), name, success,
duration_ms, confidence, iterations, verdict. One pass of conditional aggregates; no event is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def latency(values: Column, prefix: str = "latency") -> list[Column]:
    return [
        F.count(values).alias(f"{prefix}_count"),
        F.coalesce(F.sum(values), F.lit(0)).cast("long").alias(f"{prefix}_sum"),
        F.coalesce(F.min(values), F.lit(0)).cast("long").alias(f"{prefix}_min"),
        F.coalesce(F.max(values), F.lit(0)).cast("long").alias(f"{prefix}_max"),
        F.coalesce(F.avg(values), F.lit(0.0)).alias(f"{prefix}_avg"),
    ]


def latency_ms(micros: Column, prefix: str = "latency") -> list[Column]:
    """Of microseconds: sum, min and max in whole milliseconds, the mean exact."""
    ms = lambda agg: F.coalesce(F.floor(agg / 1000), F.lit(0)).cast("long")
    return [
        F.count(micros).alias(f"{prefix}_count"),
        ms(F.sum(micros)).alias(f"{prefix}_total_ms"),
        ms(F.min(micros)).alias(f"{prefix}_min_ms"),
        ms(F.max(micros)).alias(f"{prefix}_max_ms"),
        F.coalesce(F.avg(micros) / 1000, F.lit(0.0)).alias(f"{prefix}_avg_ms"),
    ]


def snapshot(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (or one a group): counts, success rates, mean routing confidence, approvals, iterations, task latency."""
    kind = F.col("kind")
    n = lambda *kinds: F.count_if(kind.isin(*kinds))
    done, failed = n("task_completed"), n("task_failed")
    tools, ok = n("tool_called"), F.count_if((kind == "tool_called") & F.col("success"))
    reflected, approved = n("reflected"), F.count_if((kind == "reflected") & (F.col("verdict") == "approved"))
    confidence = F.floor(F.when(kind == "routed", F.col("confidence")) * 1000)
    duration = F.when(kind.isin("task_completed", "task_failed"), F.col("duration_ms"))
    columns = [
        n("task_submitted").alias("submitted"),
        done.alias("completed"),
        failed.alias("failed"),
        ratio(done, done + failed).alias("task_success"),
        tools.alias("tool_calls"),
        ratio(ok, tools).alias("tool_success"),
        n("routed").alias("routed"),
        F.coalesce(F.avg(confidence) / 1000, F.lit(0.0)).alias("routing_confidence"),
        ratio(approved, reflected).alias("approval_rate"),
        F.coalesce(F.avg(F.when(kind == "reflected", F.col("iterations"))), F.lit(0.0)).alias("mean_iterations"),
        *latency(duration, "duration"),
    ]
    return events.groupBy(*by).agg(*columns) if by else events.agg(*columns)


def tool_usage(events: DataFrame) -> DataFrame:
    return events.where("kind = 'tool_called'").groupBy("name").agg(F.count(F.lit(1)).alias("calls"))


def recent(events: DataFrame, limit: int) -> DataFrame:
    """The last events, 10 at least, newest first."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(10, limit))


def ingest_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(documents, chunks, bytes)."""
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).join(chunks.agg(F.count(F.lit(1)).alias("chunks")))
