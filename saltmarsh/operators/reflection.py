"""Reflection: critiques of candidate texts, aggregate scores, verdicts over iterations.

Critiques: (task_id, iteration, dimension, score). Steps: (task_id, iteration, score, critical_ok). A verdict looks at
the two steps before its own, so it is one window over (task_id order by iteration).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vector import clamp

CRITICAL_DIMENSIONS = ("safety", "security", "correctness")


@dataclass(frozen=True)
class ReflectionConfig:
    passing_threshold: float = 0.85
    critical_threshold: float = 0.60
    max_iterations: int = 5
    regression_tolerance: float = 0.15
    stagnation_epsilon: float = 0.02


def rule_based(text: Column, min_length: int = 10, prohibited: tuple[str, ...] = ("TODO", "FIXME")) -> Column:
    """Array of (dimension, score): completeness .4 or 1, production_ready .2 or 1."""
    return F.array(
        F.struct(F.lit("completeness").alias("dimension"), F.when(F.octet_length(text) < min_length, 0.4).otherwise(1.0).alias("score")),
        F.struct(F.lit("production_ready").alias("dimension"), F.when(T.contains_any(text, *prohibited), 0.2).otherwise(1.0).alias("score")),
    )


def heuristic(text: Column, min_length: int = 20, prohibited: tuple[str, ...] = (), required: tuple[str, ...] = (), require_json: bool = False) -> Column:
    """Array of (dimension, score): completeness, safety, correctness if words are required, format_compliance if JSON is."""
    entry = lambda name, score: F.struct(F.lit(name).alias("dimension"), score.cast("double").alias("score"))
    n = F.octet_length(text)
    found = [
        entry("completeness", F.when(n < min_length, F.greatest(n / F.lit(float(max(min_length, 1))), F.lit(0.1))).otherwise(1.0)),
        entry("safety", F.when(T.contains_any(text, *prohibited), 0.2).otherwise(1.0)),
    ]
    if required:
        missing = F.lit(0)
        for word in required:
            missing = missing + F.when(text.contains(word), 0).otherwise(1)
        found.append(entry("correctness", 1 - missing / F.lit(float(len(required)))))
    if require_json:
        found.append(entry("format_compliance", F.when(T.is_json(text), 1.0).otherwise(0.0)))
    return F.array(*found)


def composite(*reflectors: Column) -> Column:
    return F.flatten(F.array(*reflectors))


def aggregate(critiques: DataFrame, config: ReflectionConfig = ReflectionConfig()) -> DataFrame:
    """(task_id, iteration, score, critical_ok): unweighted mean of the scores within [0, 1]; critical_ok is false if a
    safety, security or correctness score is below the critical threshold."""
    s = clamp(F.col("score"))
    bad = F.col("dimension").isin(*CRITICAL_DIMENSIONS) & (F.col("score") < config.critical_threshold)
    return critiques.groupBy("task_id", "iteration").agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("score"), (~F.max(bad)).alias("critical_ok"))


def verdicts(steps: DataFrame, config: ReflectionConfig = ReflectionConfig()) -> DataFrame:
    """steps with ``verdict``: approved, needs_revision, rejected or escalated."""
    w = Window.partitionBy("task_id").orderBy("iteration")
    c, now = config, F.col("score")
    x = steps.withColumns({"prev": F.lag("score", 1).over(w), "prev2": F.lag("score", 2).over(w)})
    last = F.col("iteration") >= c.max_iterations
    stuck = (F.abs(now - F.col("prev")) < c.stagnation_epsilon) & (F.abs(F.col("prev") - F.col("prev2")) < c.stagnation_epsilon)
    verdict = (
        F.when(~F.col("critical_ok"), F.when(last, "rejected").otherwise("needs_revision"))
        .when(now >= c.passing_threshold, "approved")
        .when(last, F.when(now >= 0.70, "escalated").otherwise("rejected"))
        .when(now < F.col("prev") - c.regression_tolerance, "needs_revision")
        .when(stuck, F.when(now >= c.passing_threshold - 0.05, "approved").otherwise("escalated"))
        .otherwise("needs_revision")
    )
    return x.withColumn("verdict", verdict).drop("prev", "prev2")


def states(judged: DataFrame, config: ReflectionConfig = ReflectionConfig()) -> DataFrame:
    """(task_id, iterations, converged, final_verdict, best_iteration) after the last step of each task.

    A score at the passing threshold counts as approved here even where a critical score asked for revision; at the last
    iteration a revision becomes an escalation. Of equal best scores the last step is taken.
    """
    passed = (F.col("verdict") == "approved") | (F.col("score") >= config.passing_threshold)
    final = F.when(passed, "approved").when((F.col("iteration") >= config.max_iterations) & (F.col("verdict") == "needs_revision"), "escalated").otherwise(F.col("verdict"))
    x = judged.withColumns({"state": final, "ok": passed})
    return x.groupBy("task_id").agg(
        F.max("iteration").alias("iterations"),
        F.max_by("ok", "iteration").alias("converged"),
        F.max_by("state", "iteration").alias("final_verdict"),
        F.max_by("iteration", F.struct("score", "iteration")).alias("best_iteration"),
    )
