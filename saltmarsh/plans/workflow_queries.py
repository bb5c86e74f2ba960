"""Registered workflow queries: orders as tasks, nations as agents, events as workflow events; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import graph as G
from ..operators import memory as M
from ..operators import metrics as Me
from ..operators import reflection as R
from ..operators import routing as Ro
from ..operators.workflow import Workflow
from ..session import table
from ..streaming import events as E

CAPS = ("code_execution", "reflection", "tool_calling", "storage_ops", "memory_retrieval", "text_generation")
ROLES = ("coder", "critic", "tool_executor", "memory_agent", "planner", "verifier")
TITLES = ("implement parser", "review design", "verify bench", "plan rollout", "store memory", "other work")


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    k = F.col("o_orderkey")
    required = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(CAPS, k % 6), pick(CAPS, F.expr("o_custkey % 6"))))
    return o.select(k.alias("task_id"), pick(TITLES, F.expr("o_custkey % 6")).alias("title"), F.col("o_orderstatus").alias("description"), (k % 4).cast("int").alias("priority"), required.alias("required"))


def _agents(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "nation")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    k = F.col("n_nationkey").cast("long")
    return s.select(k.alias("agent_id"), pick(ROLES, k % 6).alias("role"), F.array(pick(CAPS, k % 6), pick(CAPS, (k * 5 + 1) % 6)).alias("capabilities"), (k % 7).alias("active"), k.alias("ord"))


def _route(strategy):
    def run(spark, sf):
        found = Ro.route(_tasks(spark, sf), _agents(spark, sf), strategy)
        return found.select("task_id", "agent_id", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("fallbacks", lambda x: x.cast("string")), ",").alias("fallbacks"), F.col("error").isNotNull().alias("failed"))

    return run


def agent_load(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("agent_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_returnflag") == "R", -1).otherwise(F.when(F.col("l_returnflag") == "A", 1).otherwise(-1)).alias("delta"))
    return Ro.loads(l.groupBy("agent_id", "seq").agg(F.sum("delta").alias("delta"))).select("agent_id", "seq", "active")


def _edges(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("task"))
    return p, p.where("task > 1").select("task", F.expr("task div 2").alias("depends_on"))


def dag_tiers(spark, sf):
    return G.tiers(*_edges(spark, sf))


def dag_tiers_recursive(spark, sf):
    tasks, edges = _edges(spark, sf)
    return G.tiers_sql(tasks, edges)


def ready_tasks(spark, sf):
    tasks, edges = _edges(spark, sf)
    status = F.when(F.col("task") % 3 == 0, "completed").when(F.col("task") % 3 == 1, "pending").otherwise("running")
    return G.ready(tasks.withColumn("status", status), edges).select("task")


def workflow_summary(spark, sf):
    """Parts as tasks, each behind the part of half its number; the first critical one without a capable agent stops the run."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    required = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(CAPS, k % 6), pick(CAPS, F.expr("p_size % 6"))))
    priority = F.when(k % 97 == 96, 3).otherwise(1)
    tasks = p.select(k.alias("task_id"), pick(TITLES, F.expr("p_size % 6")).alias("title"), F.col("p_brand").alias("description"), priority.alias("priority"), required.alias("required"))
    w = Workflow("parts", tasks, _edges(spark, sf)[1], _agents(spark, sf))
    w.run("priority")
    return w.summary()


def _steps(spark, sf):
    c = table(spark, sf, "conversations")
    dim = F.when(F.col("conv_id") % 3 == 0, "safety").otherwise("style")
    score = F.pmod(F.length("text") * 7 + F.col("turn") * 3, F.lit(101)) / 100
    critiques = c.select(F.col("conv_id").alias("task_id"), (F.expr("turn div 2") + 1).alias("iteration"), dim.alias("dimension"), score.alias("score"))
    return R.verdicts(R.aggregate(critiques).withColumn("score", F.round("score", 9)))


def reflection_verdicts(spark, sf):
    return _steps(spark, sf).select("task_id", "iteration", F.round("score", 6).alias("score"), "critical_ok", "verdict")


def reflection_states(spark, sf):
    return R.states(_steps(spark, sf))


def reflection_critiques(spark, sf):
    d = table(spark, sf, "documents")
    found = R.composite(R.rule_based(F.col("text"), 200, ("reserved",)), R.heuristic(F.col("text"), 300, ("secret",), ("the", "der"), True))
    x = d.select("doc_id", F.explode(found).alias("c"))
    return x.select("doc_id", "c.dimension", F.round("c.score", 6).alias("score"))


def _events(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    kinds = ("task_submitted", "task_started", "task_completed", "task_failed", "tool_called", "routed", "reflected")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (k % 7 + 1).cast("int"))
    return e.select("event_id", "ts", "user_id", kind.alias("kind"), F.col("event_type").alias("name"), (F.col("user_id") % 3 > 0).alias("success"), (F.floor(F.col("value") * 1000)).cast("long").alias("duration_ms"), ((k % 100) / 100).alias("confidence"), (k % 5 + 1).alias("iterations"), F.when(k % 2 == 0, "approved").otherwise("rejected").alias("verdict"))


def event_metrics(spark, sf):
    x = Me.snapshot(_events(spark, sf))
    return x.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes])


def latency_summary(spark, sf):
    x = table(spark, sf, "events").groupBy("event_type").agg(*Me.latency_ms(F.floor(F.col("value") * 1_000_000)))
    return x.withColumn("latency_avg_ms", F.round("latency_avg_ms", 3))


def tool_usage(spark, sf):
    return Me.tool_usage(_events(spark, sf))


def recent_events(spark, sf):
    return Me.recent(_events(spark, sf), 25).select("event_id", "kind")


def _rounded(df):
    return df.withColumn("total", F.round("total", 4)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def event_tumbling(spark, sf):
    return _rounded(E.tumbling(table(spark, sf, "events")))


def event_sliding(spark, sf):
    return _rounded(E.sliding(table(spark, sf, "events")))


def event_session(spark, sf):
    return _rounded(E.sessions(table(spark, sf, "events")))


def event_deduplicated(spark, sf):
    return E.deduplicated(table(spark, sf, "events").unionByName(table(spark, sf, "events"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def blackboard(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("is_delete"))
    return M.blackboard(e)


def newest_episodes(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("agent_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"))
    return M.newest(e, 10).select("id", "agent_id")


def calculator(spark, sf):
    o = table(spark, sf, "lineitem")
    ops = ("add", "sub", "mul", "div", "pow", "mod", "nope")
    op = F.element_at(F.array(*map(F.lit, ops)), (F.col("l_orderkey") % 7 + 1).cast("int"))
    return o.select("l_orderkey", "l_linenumber", op.alias("op"), F.round(V.calculate(op, F.col("l_quantity"), F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_linenumber").cast("double"))), 6).alias("result"))


QUERIES = {
    **{f"route_{s}": _route(s) for s in ("default", "least_loaded", "priority", "adaptive")},
    "agent_load": agent_load, "dag_tiers": dag_tiers, "dag_tiers_recursive": dag_tiers_recursive, "ready_tasks": ready_tasks,
    "workflow_summary": workflow_summary,
    "reflection_verdicts": reflection_verdicts, "reflection_states": reflection_states, "reflection_critiques": reflection_critiques,
    "event_metrics": event_metrics, "latency_summary": latency_summary, "tool_usage": tool_usage, "recent_events": recent_events,
    "event_tumbling": event_tumbling, "event_sliding": event_sliding, "event_session": event_session, "event_deduplicated": event_deduplicated,
    "blackboard": blackboard, "newest_episodes": newest_episodes, "calculator": calculator,
}


def _list(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_ROUTING = f"""t AS (SELECT o_orderkey AS task_id, {_list(TITLES)}[o_custkey % 6 + 1] || ' ' || o_orderstatus AS txt, (o_orderkey % 4)::INT AS priority,
  CASE WHEN o_orderkey % 7 = 0 THEN []::VARCHAR[] ELSE [{_list(CAPS)}[o_orderkey % 6 + 1], {_list(CAPS)}[o_custkey % 6 + 1]] END AS req FROM orders),
a AS (SELECT n_nationkey::BIGINT AS agent_id, {_list(ROLES)}[n_nationkey % 6 + 1] AS role, [{_list(CAPS)}[n_nationkey % 6 + 1], {_list(CAPS)}[(n_nationkey * 5 + 1) % 6 + 1]] AS caps, n_nationkey % 7 AS active FROM nation),
x AS (SELECT *, CASE WHEN len(req) = 0 THEN 1 ELSE len(list_filter(req, lambda r: list_contains(caps, r))) / len(req) END AS cap,
  greatest(0, least(1, 0.5::DOUBLE {" ".join(f"+ CASE WHEN role = '{s}' THEN len(list_filter(req, lambda r: r = '{c}')) * {b}::DOUBLE ELSE 0 END" for c, s, b in Ro.ROLE_BONUS)}
  {" ".join(f"+ CASE WHEN role = '{r}' AND ({' OR '.join(f'''contains(lower(txt), '{w}')''' for w in ws)}) THEN 0.2::DOUBLE ELSE 0 END" for r, ws in Ro.ROLE_WORDS.items())})) AS role_score,
  greatest(0, least(1, 1 - active / 5)) AS load_score FROM t, a),
y AS (SELECT *, CASE priority WHEN 3 THEN CASE WHEN cap >= 0.99 THEN 1.0::DOUBLE ELSE 0.2 END WHEN 2 THEN CASE WHEN cap >= 0.75 THEN 0.9::DOUBLE ELSE 0.4 END WHEN 1 THEN 0.6 ELSE 0.5 END AS prio_score, max(cap) OVER (PARTITION BY task_id) AS top_cap FROM x)"""


def _route_sql(confidence: str, order: str, fail: str = "false") -> str:
    return f"""WITH {_ROUTING}, z AS (SELECT *, {confidence} AS confidence FROM y), n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY {order}) AS n FROM z QUALIFY n <= 3)
SELECT task_id, max(CASE WHEN n = 1 AND NOT ({fail}) THEN agent_id END) AS agent_id, round(max(CASE WHEN n = 1 AND NOT ({fail}) THEN confidence END), 6) AS confidence,
 string_agg(CASE WHEN n > 1 THEN agent_id::VARCHAR END, ',' ORDER BY n) AS fallbacks, bool_or(n = 1 AND ({fail})) AS failed FROM n GROUP BY task_id"""


def _window_sql(start: str, extra: str = "", by: str = "event_type", size: str = "1 hour") -> str:
    return f'SELECT {start} AS start, {start} + INTERVAL \'{size}\' AS "end", {by}, count(*) AS n, round(sum(value), 4) AS total FROM events {extra} GROUP BY ALL'


_STEPS = """c AS (SELECT conv_id AS task_id, turn // 2 + 1 AS iteration, CASE WHEN conv_id % 3 = 0 THEN 'safety' ELSE 'style' END AS dimension, ((length(text) * 7 + turn * 3) % 101) / 100 AS score FROM conversations),
s AS (SELECT task_id, iteration, round(avg(score), 9) AS score, NOT bool_or(dimension = 'safety' AND score < 0.6) AS critical_ok FROM c GROUP BY ALL),
l AS (SELECT *, lag(score) OVER w AS p1, lag(score, 2) OVER w AS p2 FROM s WINDOW w AS (PARTITION BY task_id ORDER BY iteration)),
v AS (SELECT *, CASE WHEN NOT critical_ok THEN CASE WHEN iteration >= 5 THEN 'rejected' ELSE 'needs_revision' END WHEN score >= 0.85 THEN 'approved'
  WHEN iteration >= 5 THEN CASE WHEN score >= 0.70 THEN 'escalated' ELSE 'rejected' END WHEN score < p1 - 0.15 THEN 'needs_revision'
  WHEN abs(score - p1) < 0.02 AND abs(p1 - p2) < 0.02 THEN CASE WHEN score >= 0.80 THEN 'approved' ELSE 'escalated' END ELSE 'needs_revision' END AS verdict FROM l)"""
_EV = f"e AS (SELECT event_id, ts, {_list(('task_submitted', 'task_started', 'task_completed', 'task_failed', 'tool_called', 'routed', 'reflected'))}[event_id % 7 + 1] AS kind, event_type AS name, user_id % 3 > 0 AS success, floor(value * 1000)::BIGINT AS duration_ms, floor((event_id % 100) / 100 * 1000) AS confidence, event_id % 5 + 1 AS iterations, event_id % 2 = 0 AS approved FROM events)"

SQL = {
    "route_default": _route_sql("CASE WHEN len(req) > 0 AND top_cap > 0 THEN cap ELSE 0.5::DOUBLE END", "CASE WHEN len(req) > 0 AND top_cap > 0 THEN cap ELSE 0 END DESC, agent_id"),
    "route_least_loaded": _route_sql("greatest(0, least(1, cap * 0.7::DOUBLE + load_score * 0.3::DOUBLE))", "cap DESC, active, agent_id"),
    "route_priority": _route_sql("cap * 0.6::DOUBLE + role_score * 0.4::DOUBLE", "confidence DESC, agent_id", "priority = 3 AND cap < 0.8 AND len(req) > 0"),
    "route_adaptive": _route_sql("greatest(0, least(1, cap * 0.45::DOUBLE + role_score * 0.25::DOUBLE + load_score * 0.20::DOUBLE + prio_score * 0.10::DOUBLE))", "confidence DESC, agent_id"),
    "agent_load": """WITH d AS (SELECT l_suppkey AS agent_id, l_orderkey * 10 + l_linenumber AS seq, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END) AS delta FROM lineitem GROUP BY ALL),
s AS (SELECT *, sum(delta) OVER (PARTITION BY agent_id ORDER BY seq) AS s FROM d) SELECT agent_id, seq, (s - least(0, min(s) OVER (PARTITION BY agent_id ORDER BY seq)))::BIGINT AS active FROM s""",
    "dag_tiers": "SELECT p_partkey AS task, (length(bin(p_partkey)) - 1)::INT AS tier FROM part",
    "dag_tiers_recursive": "WITH RECURSIVE w(task, tier) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey <= 1 UNION ALL SELECT p_partkey, tier + 1 FROM w JOIN part ON p_partkey // 2 = w.task AND p_partkey > 1) SELECT task, max(tier)::INT AS tier FROM w GROUP BY task",
    "workflow_summary": f"""WITH {_ROUTING.split("FROM orders")[0].replace("o_orderkey", "p_partkey").replace("o_custkey", "p_size").replace("o_orderstatus", "p_brand").replace("(p_partkey % 4)::INT", "CASE WHEN p_partkey % 97 = 96 THEN 3 ELSE 1 END")}FROM part{_ROUTING.split("FROM orders")[1]},
z AS (SELECT *, cap * 0.6::DOUBLE + role_score * 0.4::DOUBLE AS fit FROM y), n AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY fit DESC, agent_id) = 1),
o AS (SELECT *, row_number() OVER (ORDER BY length(bin(task_id)), task_id) AS place, priority = 3 AND cap < 0.8 AND len(req) > 0 AS bad FROM n), s AS (SELECT min(place) FILTER (bad) AS stop FROM o),
c AS (SELECT count(*) AS total, count(*) FILTER (stop IS NULL OR place < stop) AS done, count(*) FILTER (place = stop) AS failed FROM o, s)
SELECT 'parts' AS workflow_id, CASE WHEN failed = 0 THEN 'succeeded' ELSE 'failed' END AS status, total AS total_tasks, done AS completed_tasks, failed AS failed_tasks, 2 * done AS total_messages FROM c""",
    "ready_tasks": "SELECT p_partkey AS task FROM part WHERE p_partkey % 3 = 1 AND (p_partkey <= 1 OR (p_partkey // 2) % 3 = 0)",
    "reflection_verdicts": f"WITH {_STEPS} SELECT task_id, iteration, round(score, 6) AS score, critical_ok, verdict FROM v",
    "reflection_states": f"""WITH {_STEPS}, st AS (SELECT *, verdict = 'approved' OR score >= 0.85 AS ok FROM v)
SELECT task_id, max(iteration) AS iterations, arg_max(ok, iteration) AS converged, arg_max(CASE WHEN ok THEN 'approved' WHEN iteration >= 5 AND verdict = 'needs_revision' THEN 'escalated' ELSE verdict END, iteration) AS final_verdict, arg_max(iteration, (score, iteration)) AS best_iteration FROM st GROUP BY task_id""",
    "reflection_critiques": """WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, 'completeness' AS dimension, CASE WHEN n < 200 THEN 0.4::DOUBLE ELSE 1 END AS score FROM d UNION ALL SELECT doc_id, 'production_ready', CASE WHEN contains(text, 'reserved') THEN 0.2::DOUBLE ELSE 1 END FROM d
UNION ALL SELECT doc_id, 'completeness', round(CASE WHEN n < 300 THEN greatest(n / 300, 0.1) ELSE 1.0 END, 6) FROM d UNION ALL SELECT doc_id, 'safety', CASE WHEN contains(text, 'secret') THEN 0.2::DOUBLE ELSE 1 END FROM d
UNION ALL SELECT doc_id, 'correctness', 1 - (CASE WHEN contains(text, 'the') THEN 0 ELSE 1 END + CASE WHEN contains(text, 'der') THEN 0 ELSE 1 END) / 2 FROM d UNION ALL SELECT doc_id, 'format_compliance', CASE WHEN json_valid(text) THEN 1.0::DOUBLE ELSE 0 END FROM d""",
    "event_metrics": f"""WITH {_EV} SELECT count(*) FILTER (kind = 'task_submitted') AS submitted, count(*) FILTER (kind = 'task_completed') AS completed, count(*) FILTER (kind = 'task_failed') AS failed,
 round(count(*) FILTER (kind = 'task_completed') / count(*) FILTER (kind IN ('task_completed', 'task_failed')), 6) AS task_success, count(*) FILTER (kind = 'tool_called') AS tool_calls, round(count(*) FILTER (kind = 'tool_called' AND success) / count(*) FILTER (kind = 'tool_called'), 6) AS tool_success,
 count(*) FILTER (kind = 'routed') AS routed, round(avg(confidence) FILTER (kind = 'routed') / 1000, 6) AS routing_confidence, round(count(*) FILTER (kind = 'reflected' AND approved) / count(*) FILTER (kind = 'reflected'), 6) AS approval_rate, round(avg(iterations) FILTER (kind = 'reflected'), 6) AS mean_iterations,
 count(duration_ms) FILTER (kind IN ('task_completed', 'task_failed')) AS duration_count, sum(duration_ms) FILTER (kind IN ('task_completed', 'task_failed'))::BIGINT AS duration_sum, min(duration_ms) FILTER (kind IN ('task_completed', 'task_failed')) AS duration_min, max(duration_ms) FILTER (kind IN ('task_completed', 'task_failed')) AS duration_max, round(avg(duration_ms) FILTER (kind IN ('task_completed', 'task_failed')), 6) AS duration_avg FROM e""",
    "latency_summary": "WITH e AS (SELECT event_type, floor(value * 1000000)::BIGINT AS v FROM events) SELECT event_type, count(v) AS latency_count, floor(sum(v) / 1000)::BIGINT AS latency_total_ms, floor(min(v) / 1000)::BIGINT AS latency_min_ms, floor(max(v) / 1000)::BIGINT AS latency_max_ms, round(avg(v) / 1000, 3) AS latency_avg_ms FROM e GROUP BY event_type",
    "tool_usage": f"WITH {_EV} SELECT name, count(*) AS calls FROM e WHERE kind = 'tool_called' GROUP BY name",
    "recent_events": f"WITH {_EV} SELECT event_id, kind FROM e ORDER BY ts DESC, event_id DESC LIMIT 25",
    "event_tumbling": _window_sql("time_bucket(INTERVAL '1 hour', ts)"),
    "event_sliding": _window_sql("time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes' * i", ", range(0, 4) r(i)"),
    "event_session": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
    "event_deduplicated": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "blackboard": "WITH n AS (SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id) SELECT key, value FROM n WHERE value <> 'error'",
    "newest_episodes": "SELECT event_id AS id, user_id AS agent_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT DESC, event_id DESC) <= 10",
    "calculator": f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_list(("add", "sub", "mul", "div", "pow", "mod", "nope"))}[l_orderkey % 7 + 1] AS op, l_quantity AS a, CASE WHEN l_linenumber = 1 THEN 0.0::DOUBLE ELSE l_linenumber END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, op, round(CASE op WHEN 'add' THEN a + b WHEN 'sub' THEN a - b WHEN 'mul' THEN a * b WHEN 'div' THEN CASE WHEN b <> 0 THEN a / b END WHEN 'pow' THEN pow(a, b) WHEN 'mod' THEN CASE WHEN b <> 0 THEN a % b END END, 6) AS result FROM x""",
}
