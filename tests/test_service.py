"""Tools, the JSON-RPC server and the command line."""

import io
import json

import pytest

from saltmarsh import cli
from saltmarsh.operators.kv import KVStore
from saltmarsh.service.rpc import default_server
from saltmarsh.service.tools import builtin


@pytest.fixture
def store(spark, tmp_path):
    return KVStore(spark, f"file://{tmp_path}/db")


def test_tools(store):
    r = builtin(store)
    assert r.call("calculator", {"op": "mod", "a": -7, "b": 3}) == -1
    out = r.dispatch([("calculator", {"op": "div", "a": 1, "b": 0}), ("kv_put", {"key": "a", "value": "1"}), ("kv_get", {"key": "a"}), ("kv_get", {}), ("nope", {})])
    assert [o["success"] for o in out] == [False, True, True, False, False] and out[2]["output"] == "1"
    assert "missing arguments: key" in out[3]["error"]
    assert r.call("kv_scan") == [{"key": "a", "value": "1"}]


def test_rpc(store):
    s = default_server(store, builtin(store))
    ask = lambda method, **params: s.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert ask("initialize")["result"]["serverInfo"]["name"] == "saltmarsh" and ask("ping")["result"] == {}
    assert "kv_get" in [t["name"] for t in ask("tools/list")["result"]["tools"]]
    assert ask("tools/call", name="echo", arguments={"text": "hi"})["result"]["content"][0]["text"] == "hi"
    assert ask("tools/call", name="echo")["result"]["isError"]
    assert ask("tools/call", name="none")["error"]["code"] == -32602 and ask("nothing")["error"]["code"] == -32601
    assert s.handle("{")["error"]["code"] == -32700 and s.handle("[]")["error"]["code"] == -32600
    assert json.loads(ask("resources/read", uri="store://stats")["result"]["contents"][0]["text"])["version"] == 0
    assert "goal" in ask("prompts/list")["result"]["prompts"][0]["arguments"]
    assert "ship" in ask("prompts/get", name="orchestrate", arguments={"goal": "ship"})["result"]["messages"][0]["content"]["text"]
    assert ask("prompts/get", name="orchestrate")["error"]["code"] == -32602
    assert s.handle({"jsonrpc": "2.0", "method": "notifications/initialized"}) is None and s.initialized
    assert ask("logging/setLevel", level="error")["result"] == {} and "error" in ask("logging/setLevel", level="loud")
    s.notify("info", "x")
    s.notify("alert", "y")
    assert [x["message"] for x in s.log] == ["y"]
    out = io.StringIO()
    s.serve(io.StringIO('{"jsonrpc":"2.0","id":7,"method":"ping"}\n\n'), out)
    assert json.loads(out.getvalue())["id"] == 7


def test_repl_and_commands(spark, store, tmp_path):
    (tmp_path / "ops").write_text("put x 1\nput y 2\ndelete x\n")
    (tmp_path / "d.json").write_text('{"id":"a","text":"storage engine","kind":"db"}\n{"id":"b","text":"pasta engine","kind":"food"}\n')
    said = []
    cli.repl(spark, store, ['put k "two words"', "get k", f"batch {tmp_path}/ops", "scan --reverse", "bogus", 'bad "quote', f"query {tmp_path}/d.json engine --filter kind=food", "exit", "get k"], said.append)
    assert said[1] == "two words" and said[2] == "3" and said[3] == "y  2\nk  two words"
    assert said[4].startswith("error") and said[5].startswith("error") and "pasta" in said[6] and len(said) == 7
    assert cli.show([{"a": 1, "b": "x\ny"}], "tsv") == "a\tb\n1\tx y" and json.loads(cli.show([{"a": 1}], "json")) == [{"a": 1}]


def test_engine_and_workflow_commands(spark, tmp_path):
    """The rag and agent commands over one store, as lines of the prompt."""
    import json

    from saltmarsh.cli import repl
    from saltmarsh.operators.kv import KVStore

    (tmp_path / "docs.json").write_text(json.dumps([{"id": 1, "text": "spark runs queries on a cluster of machines"}, {"id": 2, "text": "python is a friendly language"}]))
    (tmp_path / "flow.json").write_text(json.dumps({"tasks": [{"id": "a", "title": "plan", "depends_on": []}, {"id": "b", "title": "implement", "priority": "High", "required_capabilities": ["code_execution"], "depends_on": ["a"]}]}))
    (tmp_path / "agents.json").write_text(json.dumps([{"id": "coder-1", "role": "coder", "capabilities": ["code_execution"]}]))
    store, out = KVStore(spark, f"file://{tmp_path}/db"), []
    lines = [f"rag-ingest {tmp_path}/docs.json", "rag-ask 'queries on a cluster' --top-k 1", "rag-delete 1,7", "rag-ask 'queries on a cluster' --top-k 1", f"agent-run {tmp_path}/flow.json {tmp_path}/agents.json", "agent-status flow --status completed", "flush", "vacuum"]
    repl(spark, store, lines, out.append)
    assert out[0].split() == ["2", "72", "2"] and out[1].split()[:2] == ["1", "1"] and out[2] == "1" and out[3].split()[1] == "2"
    assert out[4].split()[:4] == ["flow", "succeeded", "2", "2"] and out[5].split() == ["a", "completed", "b", "completed"] and out[6:] == ["0", "0"]


def test_engine_tools_and_resources(spark, tmp_path):
    from saltmarsh.operators.rag import Rag
    from saltmarsh.operators.workflow import Workflow
    from saltmarsh.service.rpc import default_server
    from saltmarsh.service.tools import builtin
    from saltmarsh.operators.kv import KVStore

    rag = Rag(spark, f"file://{tmp_path}/rag")
    rag.ingest(spark.createDataFrame([(1, "spark runs queries on a cluster")], "doc_id long, text string"))
    tasks = spark.createDataFrame([("a", "plan", "", 1, [])], "task_id string, title string, description string, priority int, required array<string>")
    w = Workflow("w", tasks, spark.createDataFrame([], "task string, depends_on string"), spark.createDataFrame([("p", "planner", ["text_generation"])], "agent_id string, role string, capabilities array<string>"))
    store = KVStore(spark, f"file://{tmp_path}/kv")
    server = default_server(store, builtin(store, rag, w), rag, w)
    call = lambda method, **p: server.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": p})["result"]
    assert '"doc_id": 1' in call("tools/call", name="rag_query", arguments={"query": "a cluster"})["content"][0]["text"]
    assert "succeeded" in call("tools/call", name="agent_run", arguments={})["content"][0]["text"]
    assert {r["uri"] for r in call("resources/list")["resources"]} >= {"rag://stats", "rag://config", "agent://state", "agent://agents"}
    for uri, part in (("rag://stats", '"documents": 1'), ("rag://config", '"ttl": 3600'), ("agent://state", '"completed": 1'), ("agent://agents", '"planner"')):
        assert part in call("resources/read", uri=uri)["contents"][0]["text"]
