"""Command line: ``python -m saltmarsh.cli COMMAND``. Also an interactive prompt over the same commands."""

from __future__ import annotations

import argparse
import json
import os
import shlex
import sys
import time

from pyspark.sql import functions as F

from .functions import predicates as P
from .operators import evaluate as Ev
from .operators import kv as K
from .operators.chunk import ChunkConfig, chunk
from .operators.rag import Rag
from .operators.retrieve import HybridEngine, RagQuery
from .operators.workflow import Workflow
from .service.rpc import default_server
from .service.tools import builtin
from .session import build_session
from .sources import documents as Src


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="saltmarsh")
    p.add_argument("--db", default=os.environ.get("SALTMARSH_DB"), required="SALTMARSH_DB" not in os.environ, help="folder that all executors share")
    p.add_argument("--format", choices=("text", "json", "tsv"), default="text")
    c = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **options) -> argparse.ArgumentParser:
        one = c.add_parser(name)
        for a in arguments:
            one.add_argument(a)
        for o, kind in options.items():
            one.add_argument(f"--{o.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"action": "append", "default": []} if kind is list else {"type": kind}))
        return one

    add("put", "key", "value")
    add("get", "key")
    add("delete", "key")
    add("scan", start=str, end=str, limit=int, reverse=bool)
    add("batch", "file")
    for name in ("compact", "flush", "stats", "inspect", "repl", "serve"):
        add(name)
    add("vacuum", older_than=float)
    add("rag-ingest", "documents")
    add("rag-ask", "text", top_k=int)
    add("rag-delete", "ids")
    add("rag-stats")
    add("agent-run", "workflow", "agents", strategy=str)
    add("agent-status", "workflow_id", status=str)
    add("bench", ops=int)
    add("query", "documents", "text", top_k=int, filter=list, min_score=float, rerank=bool)
    add("chunk", "documents", strategy=str, size=int, overlap=int)
    add("evaluate", "samples", k=int)
    add("self-eval", "documents", k=int)
    return p


def show(rows: list[dict], kind: str) -> str:
    if kind == "json":
        return json.dumps(rows, default=str)
    sep = "\t" if kind == "tsv" else "  "
    head = [sep.join(rows[0])] if rows and kind == "tsv" else []
    return "\n".join([*head, *(sep.join(str(v).replace("\n", " ") for v in r.values()) for r in rows)])


def _text(b) -> str:
    return bytes(b).decode("utf-8", "replace")


def run(args: argparse.Namespace, spark, store: K.KVStore) -> list[dict]:
    """The rows of a command's answer."""
    name = args.command
    if name == "put":
        store.put(args.key.encode(), args.value.encode())
    elif name == "delete":
        store.delete(args.key.encode())
    elif name == "get":
        value = store.get(args.key.encode())
        return [] if value is None else [{"value": _text(value)}]
    elif name == "scan":
        of = lambda s: s.encode() if s else None
        return [{"key": _text(r.key), "value": _text(r.value)} for r in store.scan(of(args.start), of(args.end), args.limit, args.reverse).collect()]
    elif name == "batch":
        ops = Src.parse_ops(spark.read.text(args.file).coalesce(1)).withColumn("op_idx", F.monotonically_increasing_id())
        n = store.write(ops.select("op_idx", F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"), (F.col("op") == "delete").alias("is_delete")))
        return [{"operations": n}]
    elif name == "compact":
        return [{"compactions": store.compact()}]
    elif name == "flush":
        return [{"version": store.flush()}]
    elif name == "vacuum":
        return [{"deleted": store.vacuum(*([args.older_than] if args.older_than is not None else []))}]
    elif name.startswith("rag-"):
        rag = Rag(spark, f"{store.path}/rag")
        if name == "rag-ingest":
            docs = Src.documents(spark, args.documents)
            return [rag.ingest(docs.select(F.col("id").cast("long").alias("doc_id"), "text", *[c for c in docs.columns if c not in ("id", "text")]))]
        if name == "rag-delete":
            return [{"deleted": rag.delete(spark.createDataFrame([(int(i),) for i in args.ids.split(",")], "doc_id long"))}]
        if name == "rag-stats":
            return [rag.stats()]
        q = spark.createDataFrame([(1, args.text)], "query_id long, text string")
        return [r.asDict() for r in rag.query(q, RagQuery(top_k=args.top_k or 5, rerank=True)).select("rank", "doc_id", "score").orderBy("rank").collect()]
    elif name == "agent-run":
        tasks, edges = Src.workflow(spark, args.workflow)
        levels = F.create_map(*[F.lit(x) for k, v in enumerate(("low", "medium", "high", "critical")) for x in (v, k)])
        tasks = tasks.select(F.col("id").alias("task_id"), "title", "description", F.coalesce(levels[F.lower("priority")], F.lit(1)).alias("priority"), F.coalesce("required_capabilities", F.array()).alias("required"))
        agents = spark.read.option("multiLine", True).schema("id string, role string, capabilities array<string>").json(args.agents).withColumnRenamed("id", "agent_id")
        w = Workflow(os.path.basename(args.workflow).rpartition(".")[0] or "workflow", tasks, edges, agents)
        w.run(args.strategy or "adaptive")
        w.checkpoint(f"{store.path}/workflows")
        return [w.summary().first().asDict()]
    elif name == "agent-status":
        w = Workflow.restore(spark, f"{store.path}/workflows", args.workflow_id)
        return [{"task_id": r.task_id, "status": r.status} for r in (w.by_status(args.status) if args.status else w.status()).orderBy("task_id").collect()]
    elif name == "stats":
        return [store.stats()]
    elif name == "inspect":
        return [r.asDict() for r in K.inspect(store.log())[0].collect()]
    elif name == "bench":
        n, t = args.ops or 1_000, time.time()
        store.write_batch([("put", f"bench{i:08d}".encode(), b"v" * 64) for i in range(n)])
        wrote, t = time.time() - t, time.time()
        found = store.scan(b"bench", b"benci").count()
        return [{"ops": n, "write_seconds": round(wrote, 3), "scan_seconds": round(time.time() - t, 3), "rows": found}]
    elif name in ("query", "chunk", "self-eval"):
        docs = Src.documents(spark, args.documents).withColumnRenamed("id", "doc_id")
        if name == "chunk":
            return [r.asDict() for r in chunk(docs, ChunkConfig(args.strategy or "paragraph", args.size or 200, args.overlap or 20, 10)).collect()]
        if name == "self-eval":
            return [r.asDict() for r in Ev.self_eval(docs, args.k or 10).collect()]
        meta = P.Typed([c for c, t in docs.dtypes if t in ("bigint", "double", "int")], [c for c, t in docs.dtypes if t == "string"])
        spec = RagQuery(top_k=args.top_k or 5, strategy="sparse", min_score=args.min_score, rerank=args.rerank, condition=P.compile(P.from_flags(args.filter), meta) if args.filter else None)
        q = spark.createDataFrame([(1, args.text)], "query_id long, text string")
        return [{"rank": r["rank"], "doc_id": r.doc_id, "score": round(r.score, 6), "text": r.text} for r in HybridEngine(docs).query(q, spec).orderBy("rank").collect()]
    elif name == "evaluate":
        samples = Src.samples(spark, args.samples).withColumn("query_id", F.col("query"))
        return [r.asDict() for r in Ev.macro(samples, args.k or 10).collect()]
    elif name == "serve":
        default_server(store, builtin(store)).serve()
    elif name == "repl":
        repl(spark, store)
    return []


def repl(spark, store, lines=None, out=print) -> None:
    """Commands line by line until ``exit``; a bad one is told and doesn't end it."""
    for line in lines if lines is not None else sys.stdin:
        try:
            words = shlex.split(line)
        except ValueError as e:
            out(f"error: {e}")
            continue
        if not words:
            continue
        if words[0] in ("exit", "quit"):
            break
        try:
            out(show(run(parser().parse_args(["--db", store.path, *words]), spark, store), "text"))
        except SystemExit:
            out(f"error: unknown command {words[0]!r}")
        except Exception as e:
            out(f"error: {e}")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session()
    print(show(run(args, spark, K.KVStore(spark, args.db)), args.format))
    return 0


if __name__ == "__main__":
    sys.exit(main())
