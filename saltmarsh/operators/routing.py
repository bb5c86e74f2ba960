"""Routing tasks to agents: capability, role, load and priority scores, four strategies.

Tasks: task_id, title, description, priority (0 to 3), required array<string>. Agents: agent_id, role, capabilities
array<string>, active (running tasks), ord (registration order, optional). Agents are broadcast in turns of bounded size;
ties go to the smaller agent_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.text import contains_any

TURN, CONCURRENCY, CRITICAL = 2_000, 5, 0.8
WEIGHTS = (0.45, 0.25, 0.20, 0.10)
#: (capability asked for, role that suits it, bonus)
ROLE_BONUS = (
    ("code_execution", "coder", 0.25),
    ("reflection", "critic", 0.25),
    ("tool_calling", "tool_executor", 0.2),
    ("storage_ops", "memory_agent", 0.25),
    ("memory_retrieval", "memory_agent", 0.25),
    ("text_generation", "planner", 0.15),
)
ROLE_WORDS = {
    "coder": ("code", "implement", "refactor"),
    "critic": ("critique", "review", "inspect"),
    "verifier": ("test", "verify", "bench"),
    "planner": ("plan", "decompose", "design"),
    "memory_agent": ("store", "memory", "rag"),
}


def capability(required: Column, capabilities: Column) -> Column:
    """Share of the required capabilities, repeats counted; 1 if none is required."""
    have = F.size(F.filter(required, lambda r: F.array_contains(capabilities, r)))
    return F.when(F.size(required) == 0, 1.0).otherwise(F.try_divide(have, F.size(required)))


def _is(name: str):
    return lambda x: x == name


def role_affinity(required: Column, role: Column, words: Column) -> Column:
    """words: the roles that the task's text calls for."""
    bonus = F.lit(0.5)
    for cap, suits, value in ROLE_BONUS:
        n = F.size(F.filter(required, _is(cap)))
        bonus = bonus + F.when(role == suits, n * value).otherwise(0.0)
    return V.clamp(bonus + F.when(F.array_contains(words, role), 0.2).otherwise(0.0))


def classes(tasks: DataFrame) -> DataFrame:
    """Tasks with ``words`` (the roles that their texts call for): scores depend on it, required and priority alone."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    called = [F.when(contains_any(text, *keywords), F.lit(role)) for role, keywords in ROLE_WORDS.items()]
    return tasks.withColumn("words", F.array_compact(F.array(*called)))


def scored(rows: DataFrame, agents: DataFrame, concurrency: int = CONCURRENCY) -> DataFrame:
    """rows (class_id, required, priority, words), each with every agent and all scores."""
    active = F.col("active") if "active" in agents.columns else F.lit(0)
    ord_ = F.col("ord") if "ord" in agents.columns else F.col("agent_id")
    a = agents.select("agent_id", "role", "capabilities", active.alias("active"), ord_.alias("ord"))
    x = rows.join(F.broadcast(a), F.lit(True))  # a turn of agents at most
    x = x.withColumn("cap", capability(F.col("required"), F.col("capabilities")))
    x = x.withColumn("role_score", role_affinity(F.col("required"), F.col("role"), F.col("words")))
    return x.withColumns({"load_score": V.workload(F.col("active"), concurrency), "prio_score": V.priority_tier(F.col("priority"), F.col("cap"))})


def route(tasks: DataFrame, agents: DataFrame, strategy: str = "adaptive", concurrency: int = CONCURRENCY, weights: tuple = WEIGHTS, critical: float = CRITICAL, turn: int = TURN) -> DataFrame:
    """(task_id, agent_id, confidence, fallbacks, error): default, least_loaded, priority or adaptive.

    Fallbacks are the next two candidates. A critical task whose best agent has less than ``critical`` of what it
    requires is an error under ``priority``; its agent is null. Tasks that ask for the same are routed once. Agents are
    taken in turns of about ``turn``; each turn gives its best three.
    """
    if strategy not in ("default", "least_loaded", "priority", "adaptive"):
        raise ValueError(f"unknown strategy {strategy!r}")
    tasks = classes(tasks)
    asked = ["required", "priority", "words"]
    kinds = tasks.select(*asked).distinct().withColumn("class_id", F.struct(*asked))
    # (fit, order): the best agent has the least order.
    need = F.size("required") > 0
    if strategy == "default":
        order, confidence = F.struct(-F.col("cap"), F.col("ord"), F.col("agent_id")), F.when(need & (F.col("cap") > 0), F.col("cap")).otherwise(0.5)
    elif strategy == "least_loaded":
        order, confidence = F.struct(-F.col("cap"), F.col("active"), F.col("agent_id")), V.clamp(F.col("cap") * 0.7 + F.col("load_score") * 0.3)
    else:
        a, b, c, d = weights
        fit = F.col("cap") * 0.6 + F.col("role_score") * 0.4 if strategy == "priority" else V.clamp(F.col("cap") * a + F.col("role_score") * b + F.col("load_score") * c + F.col("prio_score") * d)
        order, confidence = F.struct(-fit, F.col("agent_id")), V.clamp(fit)
    pick = F.struct(order.alias("order"), F.col("agent_id"), confidence.alias("confidence"), F.col("cap"))
    turns, best = max(1, -(-agents.count() // turn)), None
    for k in range(turns):
        part = agents.where(F.pmod(F.xxhash64("agent_id"), F.lit(turns)) == k) if turns > 1 else agents
        found = scored(kinds, part, concurrency).groupBy("class_id").agg(F.slice(F.array_sort(F.collect_list(pick)), 1, 3).alias("best"))
        best = found if best is None else best.unionByName(found)
    if turns > 1:
        best = best.groupBy("class_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, 3).alias("best"))
    g = tasks.withColumn("class_id", F.struct(*asked)).join(best, "class_id", "left")
    first = F.try_element_at("best", F.lit(1))
    unsafe = F.coalesce((F.col("priority") == 3) & (first["cap"] < critical) & need, F.lit(False)) & F.lit(strategy == "priority")
    fallbacks = F.coalesce(F.transform(F.slice("best", 2, 2), lambda s: s["agent_id"]), F.array())
    return g.select("task_id", F.when(~unsafe, first["agent_id"]).alias("agent_id"), F.when(~unsafe, first["confidence"]).alias("confidence"), fallbacks.alias("fallbacks"), F.when(unsafe, F.lit("critical task without a capable agent")).alias("error"))


def loads(events: DataFrame) -> DataFrame:
    """events (agent_id, seq, delta of +1 or -1) -> with ``active`` after each, never below 0.

    With the floor at 0 the load is the running sum minus the lowest running sum so far, if that is negative.
    """
    w = Window.partitionBy("agent_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = events.withColumn("s", F.sum("delta").over(w))
    return x.withColumn("active", F.col("s") - F.least(F.lit(0), F.min("s").over(w))).drop("s")
