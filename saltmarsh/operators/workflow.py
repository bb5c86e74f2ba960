"""Running a workflow: tasks by tier, routed to agents, executed, with reports, events, episodes and snapshots.

Tasks run in the order of (tier, task_id); the first that can't be routed fails and those after it stay pending. All tasks
are routed and executed in bulk: the order only decides who comes before the failure, which a minimum over the plan tells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from . import graph as G
from . import routing as Ro

STATUSES = ("pending", "assigned", "running", "completed", "failed")


def answered(tasks: DataFrame) -> DataFrame:
    """The default execution: (task_id, output), a line on the agent and the task."""
    return tasks.select("task_id", F.concat(F.lit("agent "), F.col("agent_id").cast("string"), F.lit(" completed: "), F.coalesce("title", F.lit(""))).alias("output"))


@dataclass
class Workflow:
    """tasks (task_id, title, description, priority, required), edges (task, depends_on), agents as routing takes them."""

    workflow_id: str
    tasks: DataFrame
    edges: DataFrame
    agents: DataFrame
    reports: DataFrame | None = None

    def status(self) -> DataFrame:
        """tasks with ``status``; pending before a run."""
        if self.reports is None:
            return self.tasks.withColumn("status", F.lit("pending"))
        return self.tasks.join(self.reports.select("task_id", "status"), "task_id")

    def by_status(self, status: str) -> DataFrame:
        """A status that isn't known counts as pending."""
        return self.status().where(F.col("status") == (status if status in STATUSES else "pending"))

    def run(self, strategy: str = "adaptive", execute: Callable[[DataFrame], DataFrame] = answered) -> DataFrame:
        """(task_id, tier, agent_id, confidence, status, output, error): completed, failed, or pending behind a failure."""
        tiers = G.tiers(self.tasks.select(F.col("task_id").alias("task")), self.edges).withColumnRenamed("task", "task_id")
        plan = written(Ro.route(self.tasks, self.agents, strategy).join(tiers, "task_id"), "plan")
        error = F.when(F.col("error").isNotNull() | F.col("agent_id").isNull(), F.coalesce("error", F.lit("no agent")))
        plan = plan.withColumns({"error": error, "place": F.struct("tier", "task_id")})
        first = plan.where(F.col("error").isNotNull()).agg(F.min("place").alias("stop"))
        state = F.when(F.col("stop").isNull() | (F.col("place") < F.col("stop")), "completed").when(F.col("place") == F.col("stop"), "failed").otherwise("pending")
        judged = plan.join(F.broadcast(first)).withColumn("status", state)  # one row
        done = judged.where("status = 'completed'").select("task_id", "agent_id").join(self.tasks, "task_id")
        rows = judged.join(execute(done).select("task_id", "output"), "task_id", "left")
        ran = F.col("status") != "pending"
        self.reports = written(rows.select("task_id", "tier", F.when(ran, F.col("agent_id")).alias("agent_id"), F.when(ran, F.col("confidence")).alias("confidence"), "status", "output", F.when(F.col("status") == "failed", F.col("error")).alias("error")), "reports")
        return self.reports

    def summary(self) -> DataFrame:
        """One row: status, total_tasks, completed_tasks, failed_tasks, total_messages (one a routing, one an answer)."""
        n = lambda s: F.count_if(F.col("status") == s)
        x = self.reports.agg(F.count(F.lit(1)).alias("total_tasks"), n("completed").alias("completed_tasks"), n("failed").alias("failed_tasks"))
        return x.select(F.lit(self.workflow_id).alias("workflow_id"), F.when(F.col("failed_tasks") == 0, "succeeded").otherwise("failed").alias("status"), "*", (2 * F.col("completed_tasks")).alias("total_messages"))

    def events(self) -> DataFrame:
        """(kind, task_id, agent_id) for metrics: submitted for all, started and completed or failed for those that ran."""
        kinds = F.when(F.col("status") == "completed", F.array(F.lit("task_submitted"), F.lit("task_started"), F.lit("task_completed"))).when(F.col("status") == "failed", F.array(F.lit("task_submitted"), F.lit("task_failed"))).otherwise(F.array(F.lit("task_submitted")))
        return self.reports.select(F.explode(kinds).alias("kind"), "task_id", "agent_id")

    def episodes(self, timestamp: int, importance: float = 0.8) -> DataFrame:
        """Completed tasks as episodes of their agents."""
        content = F.concat(F.lit("Task "), F.col("task_id").cast("string"), F.lit(": "), F.coalesce("output", F.lit("")))
        tags = F.array(F.lit("task_output"), F.col("agent_id").cast("string"))
        return self.reports.where("status = 'completed'").select(F.concat_ws(":", F.lit(self.workflow_id), "task_id").alias("id"), "agent_id", "task_id", F.lit(timestamp).alias("timestamp"), content.alias("content"), tags.alias("tags"), F.lit(importance).alias("importance"))

    def checkpoint(self, folder: str) -> None:
        """Writes tasks, edges, agents and reports; the reports come last and make the snapshot whole."""
        for name in ("tasks", "edges", "agents"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{self.workflow_id}/{name}")
        if self.reports is not None:
            self.reports.write.mode("overwrite").parquet(f"{folder}/{self.workflow_id}/reports")

    @classmethod
    def restore(cls, spark: SparkSession, folder: str, workflow_id: str) -> "Workflow":
        """The workflow as it was written, with its dependencies and reports."""
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{workflow_id}")
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(at):
            raise KeyError(f"no snapshot of {workflow_id}")
        read = lambda name: spark.read.parquet(f"{folder}/{workflow_id}/{name}")
        done = system.exists(jvm.org.apache.hadoop.fs.Path(at, "reports"))
        return cls(workflow_id, read("tasks"), read("edges"), read("agents"), read("reports") if done else None)
