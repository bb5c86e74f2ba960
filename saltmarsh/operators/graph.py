"""Task graphs: tiers, cycles, readiness. Tasks: (task). Edges: (task, depends_on).

Tiers come from a frontier loop over the edges that are left, a written table; a round joins them with the last tier and with
the tasks behind it, and rounds are as many as the graph is deep. A round that frees no task while some are left shows a cycle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, written


#: Tasks that are broadcast at once.
BROADCAST_ROWS = 100_000


class CycleError(ValueError):
    """The dependencies have a cycle, or a task depends on itself."""


def _checked(edges: DataFrame) -> DataFrame:
    if not edges.where(F.col("task") == F.col("depends_on")).isEmpty():
        raise CycleError("a task depends on itself")
    return edges.select("task", "depends_on").distinct()


def _side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The right side of a join: broadcast up to ``BROADCAST_ROWS``, beyond that never, so that a round sends the driver a bounded part."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df.hint("merge")


def tiers(tasks: DataFrame, edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(task, tier): 0 without dependencies, else one more than the deepest of them."""
    tasks = written(tasks.select("task").distinct(), "tasks")
    total, reached, done = tasks.count(), 0, None
    edges = written(_checked(edges).join(_side(tasks, total), "task", "left_semi"), "edges")
    now = written(tasks.join(_side(edges.select("task"), edges.count()), "task", "left_anti"), "tier")
    for tier in range(max_depth):
        n = now.count()
        if n == 0 and reached < total:
            raise CycleError("the dependencies have a cycle")
        layer = now.withColumn("tier", F.lit(tier))
        done, reached = layer if done is None else done.unionByName(layer), reached + n
        if reached == total:
            return done
        # Only tasks with a dependency in this tier can be free now: those that none of the edges left names.
        met = _side(now.select(F.col("task").alias("depends_on")), n)
        near = written(edges.join(met, "depends_on", "left_semi").select("task").distinct(), "near")
        rest = written(edges.join(met, "depends_on", "left_anti").select("task", "depends_on"), "edges")
        behind = written(rest.join(_side(near), "task", "left_semi").select("task").distinct(), "behind")
        now = written(near.join(_side(behind), "task", "left_anti"), "tier")
        discard(edges, near, behind)
        edges = rest
    if reached < total:
        raise RuntimeError(f"tasks are left after {max_depth} tiers")
    return tasks.withColumn("tier", F.lit(0))


def tiers_sql(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for graphs of at most 100 tiers, as one recursive query: the longest path to each task. It walks every path,
    so it is for trees and sparse graphs; where many paths lead to a task, tiers() is the one to use. LIMIT ALL lifts Spark's
    limit on the rows of a recursion; the hints keep tables that grow with the graph off the driver."""
    own = uuid.uuid4().hex
    tasks.createOrReplaceTempView(f"tasks_{own}")
    written(_checked(edges), "edges").createOrReplaceTempView(f"edges_{own}")
    return tasks.sparkSession.sql(f"""
        WITH RECURSIVE walk(task, tier) AS (
          SELECT /*+ MERGE(b) */ t.task, 0 FROM tasks_{own} t LEFT ANTI JOIN edges_{own} b ON t.task = b.task
          UNION ALL SELECT /*+ MERGE(e) */ e.task, w.tier + 1 FROM walk w JOIN edges_{own} e ON e.depends_on = w.task)
        SELECT task, max(tier) AS tier FROM (SELECT * FROM walk LIMIT ALL) GROUP BY task""")


def has_cycle(tasks: DataFrame, edges: DataFrame) -> bool:
    try:
        tiers(tasks, edges)
    except CycleError:
        return True
    return False


def ready(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending tasks (task, status) all of whose dependencies are completed."""
    unmet = edges.join(tasks.where("status = 'completed'").select(F.col("task").alias("depends_on")), "depends_on", "left_anti").select("task")
    return tasks.where("status = 'pending'").join(unmet, "task", "left_anti")
