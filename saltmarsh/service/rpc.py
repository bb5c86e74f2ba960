"""JSON-RPC 2.0 over lines: tools, resources, prompts, log level. Requests are dicts or texts, one answer each."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import asdict
from typing import IO, Any

from .tools import Registry

PARSE, REQUEST, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
LEVELS = ("debug", "info", "notice", "warning", "error", "critical", "alert", "emergency")


class RpcError(Exception):
    """An error with its code."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Server:
    def __init__(self, registry: Registry, name: str = "saltmarsh", version: str = "0.1.0"):
        self.registry, self.info = registry, {"name": name, "version": version}
        self.resources: dict[str, tuple[str, Callable[[], Any]]] = {}
        self.prompts: dict[str, tuple[str, tuple[str, ...], Callable[[dict], str]]] = {}
        self.level, self.initialized, self.log = "info", False, []
        self.methods: dict[str, Callable[[dict], Any]] = {
            "initialize": self._initialize,
            "ping": lambda p: {},
            "tools/list": lambda p: {"tools": [self.registry.tools[n].schema() for n in self.registry.names()]},
            "tools/call": self._call,
            "resources/list": lambda p: {"resources": [{"uri": u, "description": d} for u, (d, _) in sorted(self.resources.items())]},
            "resources/read": self._read,
            "prompts/list": lambda p: {"prompts": [{"name": n, "description": d, "arguments": list(a)} for n, (d, a, _) in sorted(self.prompts.items())]},
            "prompts/get": self._prompt,
            "logging/setLevel": self._level,
            "notifications/initialized": lambda p: setattr(self, "initialized", True),
        }

    def resource(self, uri: str, description: str, read: Callable[[], Any]) -> "Server":
        self.resources[uri] = (description, read)
        return self

    def prompt(self, name: str, description: str, arguments: tuple[str, ...], render: Callable[[dict], str]) -> "Server":
        self.prompts[name] = (description, arguments, render)
        return self

    def notify(self, level: str, message: str) -> None:
        """Kept if it is at the threshold or above."""
        if LEVELS.index(level) >= LEVELS.index(self.level):
            self.log.append({"level": level, "message": message})

    def _initialize(self, params: dict) -> dict:
        return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "serverInfo": self.info, "capabilities": {"tools": {}, "resources": {}, "prompts": {}, "logging": {}}}

    def _name(self, params: dict, key: str, known: dict) -> str:
        if not isinstance(params.get(key), str):
            raise RpcError(PARAMS, f"{key} is missing")
        if params[key] not in known:
            raise RpcError(PARAMS, f"unknown {key}: {params[key]}")
        return params[key]

    def _call(self, params: dict) -> dict:
        name = self._name(params, "name", self.registry.tools)
        try:
            found, failed = self.registry.call(name, params.get("arguments") or {}), False
        except Exception as e:  # a failing tool is a result, no protocol error
            found, failed = f"{type(e).__name__}: {e}", True
        text = found if isinstance(found, str) else json.dumps(found)
        return {"content": [{"type": "text", "text": text}], "isError": failed}

    def _read(self, params: dict) -> dict:
        uri = self._name(params, "uri", self.resources)
        return {"contents": [{"uri": uri, "text": json.dumps(self.resources[uri][1]())}]}

    def _prompt(self, params: dict) -> dict:
        name = self._name(params, "name", self.prompts)
        given, (_, needed, render) = params.get("arguments") or {}, self.prompts[name]
        if missing := [a for a in needed if a not in given]:
            raise RpcError(PARAMS, f"missing arguments: {', '.join(missing)}")
        return {"messages": [{"role": "user", "content": {"type": "text", "text": render(given)}}]}

    def _level(self, params: dict) -> dict:
        if params.get("level") not in LEVELS:
            raise RpcError(PARAMS, f"unknown level: {params.get('level')}")
        self.level = params["level"]
        return {}

    def handle(self, request: dict | str) -> dict | None:
        """The answer, or None to a notification."""
        number = None
        try:
            if isinstance(request, str):
                try:
                    request = json.loads(request)
                except ValueError as e:
                    raise RpcError(PARSE, f"no JSON: {e}") from None
            if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
                raise RpcError(REQUEST, "no JSON-RPC 2.0 request")
            number = request.get("id")
            if request["method"] not in self.methods:
                raise RpcError(METHOD, f"unknown method: {request['method']}")
            result = self.methods[request["method"]](request.get("params") or {})
        except RpcError as e:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": e.code, "message": str(e)}}
        except Exception as e:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": INTERNAL, "message": str(e)}}
        return None if "id" not in request else {"jsonrpc": "2.0", "id": number, "result": result}

    def serve(self, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
        for line in lines:
            if line.strip() and (answer := self.handle(line)) is not None:
                out.write(json.dumps(answer) + "\n")
                out.flush()


def default_server(store, registry: Registry, rag=None, workflow=None) -> Server:
    """The built-in resources and prompts over a store, and those of an engine and a workflow if they are given."""
    server = Server(registry)
    server.resource("store://stats", "Files, versions, bytes", store.stats)
    server.resource("store://options", "Options of the store", store.options_dict)
    server.resource("store://manifest", "Files of the current version", lambda: sorted(store.files.values(), key=lambda f: f["file"]))
    if rag is not None:
        server.resource("rag://stats", "Documents, versions, cache", rag.stats)
        server.resource("rag://config", "Chunking, cache, context", lambda: {name: asdict(getattr(rag, name)) for name in ("chunking", "cache", "context")})
    if workflow is not None:
        server.resource("agent://state", "Tasks by status", lambda: {r.status: r["count"] for r in workflow.status().groupBy("status").count().collect()})
        server.resource("agent://agents", "Registered agents", lambda: [r.asDict() for r in workflow.agents.select("agent_id", "role", "capabilities").orderBy("agent_id").limit(1_000).collect()])
    server.prompt("troubleshoot", "Looks into a store's problem", ("symptom",), lambda a: f"A store shows: {a['symptom']}\nIts figures: {json.dumps(store.stats())}\nFind the likely cause and the next check.")
    server.prompt("synthesize", "Answers from passages", ("query", "context"), lambda a: f"Answer from the passages alone.\n\n{a['context']}\n\nUser Query: {a['query']}")
    server.prompt("orchestrate", "Plans tasks for agents", ("goal",), lambda a: f"Split this goal into tasks with dependencies and required capabilities: {a['goal']}")
    return server
