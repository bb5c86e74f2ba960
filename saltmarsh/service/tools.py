"""Tools with named arguments, a registry that validates and runs them, and the built-in ones over a store."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..functions.predicates import require
from ..operators.kv import KVStore
from ..operators.rag import Rag
from ..operators.retrieve import RagQuery
from ..operators.workflow import Workflow


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    run: Callable[[dict], Any]
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    def schema(self) -> dict:
        names = [*self.required, *self.optional]
        return {"name": self.name, "description": self.description, "inputSchema": {"type": "object", "properties": {n: {} for n in names}, "required": list(self.required)}}


@dataclass
class Registry:
    tools: dict[str, Tool] = field(default_factory=dict)

    def add(self, *tools: Tool) -> "Registry":
        self.tools |= {t.name: t for t in tools}
        return self

    def names(self) -> list[str]:
        return sorted(self.tools)

    def call(self, name: str, arguments: dict | None = None) -> Any:
        """The tool's result; KeyError for an unknown tool, ValueError for a missing argument."""
        if name not in self.tools:
            raise KeyError(name)
        arguments = arguments or {}
        require(arguments, self.tools[name].required)
        return self.tools[name].run(arguments)

    def dispatch(self, calls: list[tuple[str, dict]]) -> list[dict]:
        """All calls in order; one that fails becomes an error row and doesn't stop the others."""
        out = []
        for name, arguments in calls:
            try:
                out.append({"tool": name, "success": True, "output": self.call(name, arguments), "error": None})
            except Exception as e:  # tools are the user's code
                out.append({"tool": name, "success": False, "output": None, "error": f"{type(e).__name__}: {e}"})
        return out


def calculate(op: str, a: float, b: float) -> float:
    a, b = float(a), float(b)
    if op in ("div", "mod") and abs(b) < 2.220446049250313e-16:
        raise ZeroDivisionError(f"{op} by zero")
    found = {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: a / b, "pow": lambda: a**b, "mod": lambda: math.fmod(a, b)}
    if op not in found:
        raise ValueError(f"unknown operation {op!r}")
    return found[op]()


def _pairs(df) -> list[dict]:
    return [{"key": bytes(r.key).decode("utf-8", "replace"), "value": bytes(r.value).decode("utf-8", "replace")} for r in df.collect()]


def builtin(store: KVStore | None = None, rag: Rag | None = None, workflow: Workflow | None = None) -> Registry:
    """calculator and echo; with a store also kv_get, kv_put, kv_delete, kv_scan (20 rows unless told) and kv_stats; with an
    engine rag_query, with a workflow agent_run."""
    found = Registry().add(
        Tool("calculator", "Arithmetic on two numbers", lambda x: calculate(x["op"], x["a"], x["b"]), ("op", "a", "b")),
        Tool("echo", "Returns its text", lambda x: x["text"], ("text",)),
    )
    if rag is not None:

        def ask(x: dict) -> list[dict]:
            q = rag.spark.createDataFrame([(1, str(x["query"]))], "query_id long, text string")
            rows = rag.query(q, RagQuery(top_k=int(x.get("top_k", 5)), rerank=True)).orderBy("rank").collect()
            return [{"doc_id": r.doc_id, "score": r.score, "cached": r.cached} for r in rows]

        found.add(Tool("rag_query", "The documents that answer a question", ask, ("query",), ("top_k",)))
    if workflow is not None:

        def run(x: dict) -> dict:
            workflow.run(x.get("strategy", "adaptive"))
            return workflow.summary().first().asDict()

        found.add(Tool("agent_run", "Runs the workflow's tasks", run, (), ("strategy",)))
    if store is None:
        return found

    def get(x: dict) -> str | None:
        value = store.get(x["key"].encode())
        return None if value is None else value.decode("utf-8", "replace")

    def scan(x: dict) -> list[dict]:
        start, end = x.get("start_key"), x.get("end_key")
        return _pairs(store.scan(start.encode() if start else None, end.encode() if end else None, int(x.get("limit", 20))))

    return found.add(
        Tool("kv_get", "The value of a key", get, ("key",)),
        Tool("kv_put", "Sets a key", lambda x: store.put(x["key"].encode(), x["value"].encode()), ("key", "value")),
        Tool("kv_delete", "Deletes a key", lambda x: store.delete(x["key"].encode()), ("key",)),
        Tool("kv_scan", "Keys and values in order", scan, (), ("start_key", "end_key", "limit")),
        Tool("kv_stats", "Files and versions", lambda x: store.stats()),
    )
