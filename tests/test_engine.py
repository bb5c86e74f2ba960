"""The engine with cache, ingest and delete; workflow runs and snapshots."""

import pytest

from saltmarsh.operators import metrics as Me
from saltmarsh.operators.chunk import ChunkConfig
from saltmarsh.operators.graph import CycleError
from saltmarsh.operators.rag import Rag
from saltmarsh.operators.retrieve import RagQuery
from saltmarsh.operators.workflow import Workflow

TEXTS = [(1, "rust is a fast systems language", "a"), (2, "python is a friendly scripting language", "b"), (3, "spark runs queries on a cluster", "a")]


@pytest.fixture
def rag(spark, tmp_path):
    made = Rag(spark, f"file://{tmp_path}/rag", chunking=ChunkConfig("fixed_tokens", 4, 1, 5))
    assert made.ingest(spark.createDataFrame(TEXTS, "doc_id long, text string, source string")) == {"documents": 3, "bytes": sum(len(t) for _, t, _ in TEXTS), "chunks": 6}
    return made


def test_query_fills_and_uses_the_cache(spark, rag):
    q = spark.createDataFrame([(1, "fast systems language"), (2, "queries on a cluster")], "query_id long, text string")
    first = rag.query(q, RagQuery(top_k=2, rerank=True), now=10).collect()
    assert {r.query_id: r.doc_id for r in first if r["rank"] == 1} == {1: 1, 2: 3} and not any(r.cached for r in first)
    again = rag.query(q, RagQuery(top_k=2, rerank=True), now=20).collect()
    assert all(r.cached for r in again) and sorted((r.query_id, r["rank"], r.doc_id) for r in again) == sorted((r.query_id, r["rank"], r.doc_id) for r in first)
    assert rag.stats()["cache"] == {"hits": 2, "misses": 2, "entries": 2, "hit_rate": 0.5}
    late = rag.query(q, RagQuery(top_k=2, rerank=True), now=20 + 3_600).collect()
    assert not any(r.cached for r in late)


def test_deleted_and_replaced_documents(spark, rag):
    q = spark.createDataFrame([(1, "fast systems language")], "query_id long, text string")
    rag.query(q, RagQuery(top_k=2), now=1)
    assert rag.delete(spark.createDataFrame([(1,), (99,)], "doc_id long")) == 1
    assert {r.doc_id for r in rag.documents().collect()} == {2, 3} == {r.doc_id for r in rag.chunks().select("doc_id").distinct().collect()}
    found = rag.query(q, RagQuery(top_k=2), now=2).collect()
    assert not any(r.cached or r.doc_id == 1 for r in found)
    rag.ingest(spark.createDataFrame([(2, "a fast systems language again", "z")], "doc_id long, text string, source string"))
    best = [r for r in rag.query(q, RagQuery(top_k=1), now=3).collect() if r["rank"] == 1]
    assert [(r.doc_id, r.cached) for r in best] == [(2, False)]
    assert rag.chunks().where("doc_id = 2").select("source").distinct().collect()[0][0] == "z"


def test_answers(spark, rag):
    q = spark.createDataFrame([(1, "queries on a cluster")], "query_id long, text string")
    row = rag.answer(q, RagQuery(top_k=1, rerank=True)).collect()[0]
    assert "spark runs queries" in row.context and row.prompt.endswith("User Query: queries on a cluster") and row.doc_count == 1
    assert rag.query(q, RagQuery(top_k=0)).count() == 0


TASKS = "task_id string, title string, description string, priority int, required array<string>"


def workflow(spark, last=("d", "implement it", "", 1, ["code_execution"])):
    tasks = spark.createDataFrame([("a", "plan it", "", 1, []), ("b", "review it", "", 1, ["reflection"]), ("c", "store it", "", 2, ["storage_ops"]), last], TASKS)
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], "task string, depends_on string")
    agents = spark.createDataFrame([("coder-1", "coder", ["code_execution"]), ("critic-1", "critic", ["reflection"]), ("memory-1", "memory_agent", ["storage_ops"])], "agent_id string, role string, capabilities array<string>")
    return Workflow("w", tasks, edges, agents)


def test_a_workflow_runs_by_tier(spark, tmp_path):
    w = workflow(spark)
    rows = {r.task_id: r for r in w.run().collect()}
    assert {k: r.tier for k, r in rows.items()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert [rows[k].agent_id for k in "bcd"] == ["critic-1", "memory-1", "coder-1"] and all(r.status == "completed" and r.output for r in rows.values())
    s = w.summary().collect()[0]
    assert (s.status, s.total_tasks, s.completed_tasks, s.failed_tasks, s.total_messages) == ("succeeded", 4, 4, 0, 8)
    assert Me.snapshot(w.events().selectExpr("*", "true AS success", "1L AS duration_ms", "1.0D AS confidence", "1L AS iterations", "'approved' AS verdict")).collect()[0].completed == 4
    assert w.events().groupBy("kind").count().count() == 3
    assert {(e.importance, e.tags[0]) for e in w.episodes(5).collect()} == {(0.8, "task_output")}
    w.checkpoint(f"file://{tmp_path}/snap")
    back = Workflow.restore(spark, f"file://{tmp_path}/snap", "w")
    assert back.by_status("completed").count() == 4 and back.edges.count() == 4
    assert sorted(map(str, back.run().collect())) == sorted(map(str, w.reports.collect()))
    with pytest.raises(KeyError):
        Workflow.restore(spark, f"file://{tmp_path}/snap", "none")


def test_a_workflow_stops_at_its_first_error(spark):
    w = workflow(spark, ("d", "x", "", 3, ["text_generation"]))
    w.tasks = w.tasks.union(spark.createDataFrame([("e", "y", "", 1, [])], TASKS))
    w.edges = w.edges.union(spark.createDataFrame([("e", "d")], w.edges.schema))
    rows = {r.task_id: r for r in w.run("priority").collect()}
    assert {k: r.status for k, r in rows.items()} == {"a": "completed", "b": "completed", "c": "completed", "d": "failed", "e": "pending"}
    assert rows["d"].error and rows["e"].agent_id is None and w.summary().collect()[0].status == "failed"
    assert w.by_status("what").count() == 1
    w.edges = w.edges.union(spark.createDataFrame([("a", "e")], w.edges.schema))
    with pytest.raises(CycleError):
        w.run()


def test_texts_that_nothing_replaces_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Current documents are the same whether the ids of replaced rows are broadcast or all rows go through one aggregation."""
    from pyspark.sql import functions as F

    from saltmarsh.operators import rag as module
    from saltmarsh.operators.chunk import ChunkConfig

    r = module.Rag(spark, f"file://{tmp_path}/db", embedder=None, chunking=ChunkConfig("sentence", min_chunk_size=1))
    of = lambda ids, text: spark.createDataFrame([(k, f"{text} {k}. End.", "en") for k in ids], "doc_id long, text string, lang string")
    assert r.ingest(of(range(6), "old")) == {"documents": 6, "bytes": 66, "chunks": 12}
    assert {(c.doc_id, c.lang, c.text) for c in r.chunks().where("chunk_index = 0").collect()} == {(k, "en", f"old {k}.") for k in range(6)}
    assert "Exchange" not in r.documents()._jdf.queryExecution().executedPlan().toString()
    r.ingest(of([1, 2], "new"))
    r.delete(spark.createDataFrame([(2,), (3,)], "doc_id long"))
    want = [(0, "old 0. End."), (1, "new 1. End."), (4, "old 4. End."), (5, "old 5. End.")]
    rows = lambda: [(d.doc_id, d.text) for d in r.documents().orderBy("doc_id").collect()]
    assert rows() == want
    monkeypatch.setattr(module, "MIXED", 0)
    assert rows() == want and r.documents().where(F.col("lang") == "en").count() == 4
