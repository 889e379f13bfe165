from __future__ import annotations

import asyncio
import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from strandline import config
from strandline.plans import agents, planner
from strandline.plans.registry import Registry
from strandline.web import Web, serve
from tests.test_api import service


@pytest.fixture(scope="module")
def web(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("web")
    (folder / "assets").mkdir()
    (folder / "index.html").write_text("<p>hello</p>")
    (folder / "assets" / "a.js").write_text("1")
    (folder.parent / "secret.txt").write_text("s")
    return Web(service(spark, folder), str(folder))


def call(web, method, target, body=None):
    reply = web.respond(method, target, json.dumps(body).encode() if body is not None else b"")
    return reply.status, json.loads(reply.body) if reply.media == "application/json" else reply.body.decode()


def frames(text):
    assert text.endswith("\n\n")
    return [json.loads(x.removeprefix("data: ")) for x in text.split("\n\n")[:-1]]


def test_pages(web):
    assert {call(web, "GET", p)[1] for p in ("/", "/chat", "/visualizer")} == {"<p>hello</p>"} and call(web, "GET", "/assets/a.js") == (200, "1")
    for path in ("/assets/../../secret.txt", "/assets/none", "/api/none", "/assets/%2e%2e/%2e%2e/secret.txt"):
        assert call(web, "GET", path) == (404, {"error": "Not found"})
    assert call(web, "POST", "/api/tools")[0] == 404


def test_tools_pipelines_health(web):
    status, tools = call(web, "GET", "/api/tools")
    assert status == 200 and tools["ocr"].startswith("Tool for reads.")
    assert call(web, "GET", "/api/pipelines") == (200, []) and call(web, "GET", "/api/pipeline/x%20y") == (404, {"error": "Pipeline 'x y' not found"})
    status, health = call(web, "GET", "/api/health")
    assert status == 200 and health["status"] == "healthy" and health["tools_count"] == 1 and health["agent_available"]


def test_events_and_stream(web):
    assert call(web, "POST", "/api/agui/session/s1/welcome")[1] == {"status": "welcome_sent", "events_generated": 1, "message": "Welcome message delivered"}
    status, got = call(web, "POST", "/api/agui/events", {"type": "user_message", "session_id": "s1", "data": {"message": "hi"}})
    assert status == 200 and got["status"] == "processed" and got["events_generated"] == len(got["events"]) == 6
    assert [e["type"] for e in got["events"]][:2] == ["text_message_content", "run_started"]
    status, text = call(web, "GET", "/api/agui/stream/s1")
    assert [f["type"] for f in frames(text)][:3] == ["connection_established", "custom_event", "text_message_content"]
    assert [f["type"] for f in frames(call(web, "GET", "/api/agui/stream/new")[1])] == ["connection_established"]
    assert web.respond("POST", "/api/agui/events", b"no json").status == 400 and web.respond("POST", "/api/agui/events", b"[1]").status == 400


def test_chats(web):
    assert call(web, "POST", "/api/chat/message", {"message": ""}) == (400, {"error": "Message is required"})
    assert call(web, "POST", "/api/chat/stream", {})[0] == 400
    assert call(web, "GET", "/api/chat/pipeline/c") == (404, {"error": "Session not found"})
    assert call(web, "POST", "/api/chat/message", {"message": "m", "session_id": "c"}) == (200, {"response": "re: m", "tool_calls": ["ocr"], "session_id": "c", "tool_added": True})
    assert [f["type"] for f in frames(call(web, "POST", "/api/chat/stream", {"message": "n", "session_id": "c"})[1])] == ["assistant_message", "tool_selected", "conversation_complete"]
    status, built = call(web, "GET", "/api/chat/pipeline/c")
    assert status == 200 and built["name"] == "Pipeline-c" and [n["id"] for n in built["nodes"]] == ["ocr-0", "ocr-1"]
    status, export = call(web, "GET", "/api/chat/export/c?name=My%20Work")
    assert status == 200 and export["name"] == "My Work" and "ocr-1" in export["yaml"]
    call(web, "POST", "/api/agui/session/quiet/welcome")
    assert call(web, "GET", "/api/chat/pipeline/quiet") == (404, {"error": "No pipeline found for session"}) == call(web, "GET", "/api/chat/export/quiet")


def test_served(web):
    server = serve(web)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    with urllib.request.urlopen(base + "/api/pipelines") as r:
        assert json.load(r) == []
    request = urllib.request.Request(base + "/api/chat/stream", json.dumps({"message": "x", "session_id": "z"}).encode())
    with urllib.request.urlopen(request) as r:
        assert r.headers["Content-Type"] == "text/event-stream" and len(frames(r.read().decode())) == 3
    server.shutdown()
    server.server_close()


def test_connectors():
    seen = []

    def post(url, body, headers, timeout):
        seen.append((url, body, headers))
        return {"message": {"content": "a"}, "choices": [{"message": {"content": "b"}}]}

    c = config.LlmConfig(system_prompt="be brief", base_url="http://h/")
    assert agents.chat_model(c, post=post)([{"role": "user", "content": "q"}]) == "a"
    assert seen[0][0] == "http://h/api/chat" and [m["role"] for m in seen[0][1]["messages"]] == ["system", "user"]
    c.provider = "openai"
    assert agents.chat_model(c, "k", post=post)([]) == "b" and seen[1][0] == "http://h/chat/completions" and seen[1][2] == {"Authorization": "Bearer k"}
    c.provider = "other"
    with pytest.raises(ValueError):
        agents.chat_model(c)


def test_planner_with_a_model(spark):
    def model(messages):
        if messages[-1]["content"] == "break":
            raise OSError("no server")
        return json.dumps({"steps": [{"tool_name": "t"}], "reasoning": "r", "confidence": 0.9, "input_types": [], "output_types": [], "estimated_time": 5}) if messages[-1]["content"] == "good" else "well"

    requests = spark.createDataFrame([(1, "good"), (2, "break"), (3, "read")], "request_id long, query string")
    got = {r.request_id: r.plan for r in planner.plan_requests(requests, agents.model_planner(model, "- t")).collect()}
    assert got[1].confidence == 0.9 and got[2].confidence == 0.1 and "no server" in got[2].reasoning and got[3].steps[0].tool_name == "easyocr-wrapper"


def test_tool_loop(spark):
    def model(messages):
        asked, results = messages[1]["content"], [m["content"] for m in messages if m["role"] == "tool"]
        if asked == "fail":
            raise OSError("down")
        if asked == "loop" or len(results) < 2 and asked == "twice":
            return json.dumps({"tool": "upper" if len(results) < 1 else "gone", "input": "x", "parameters": {}})
        return f"answer {results}"

    registry = Registry().add("upper", lambda v, p: v.upper())
    messages = spark.createDataFrame([("s", 1, "twice"), ("s", 2, "plain"), ("s", 3, "fail"), ("s", 4, "loop")], "session_id string, message_ord long, message string")
    rows = agents.tool_agent(model, registry, 3)(messages).orderBy("message_ord", "ord").collect()
    kinds = {m: [(r.type, r.content, r.tool_name) for r in rows if r.message_ord == m] for m in range(1, 5)}
    gone = '{"error": "Tool gone not found"}'
    assert kinds[1] == [("tool_selected", None, "upper"), ("tool_result", "X", "upper"), ("tool_selected", None, "gone"), ("tool_result", gone, "gone"), ("assistant_message", f"answer {['X', gone]}", None), ("conversation_complete", "completed", None)]
    assert [k for k, *_ in kinds[2]] == ["assistant_message", "conversation_complete"] and kinds[3] == [("error", "down", None)]
    assert kinds[4][-1] == ("error", "no answer within 3 rounds", None) and len(kinds[4]) == 7
    assert asyncio.run(agents.call_async(registry, "upper", "a", {})) == (True, "A", None)


def test_ranks(spark):
    from strandline.operators.sequences import with_rank

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("rank_of"))
    assert {r.k: r.rank for r in with_rank(df, ["k"]).collect()} == {k: k + 1 for k in range(1000)}
    assert with_rank(df.limit(0), ["k"]).count() == 0


def test_a_session_is_greeted_once_and_keeps_all_its_tools(spark, tmp_path):
    """The agent is asked once for each message, however often the answers and the pipeline are looked at."""
    asked = []

    def agent(messages):
        rows = messages.collect()
        asked.extend(r.message for r in rows)
        made = [(r.session_id, r.message_ord, i, *u) for r in rows for i, u in enumerate((("tool_selected", None, r.message), ("assistant_message", "re " + r.message, None)))]
        return spark.createDataFrame(made, agents.UPDATES)

    s = service(spark, tmp_path)
    s.agent = agent
    w = Web(s)
    greetings = 0
    for i in range(2):
        got = call(w, "POST", "/api/agui/events", {"type": "user_message", "session_id": "s", "data": {"message": f"t{i}"}})[1]["events"]
        greetings += sum((e["data"]["content"] or "").startswith("Hello!") for e in got)
    assert greetings == 1 and asked == ["t0", "t1"]
    for i in range(2, 60):
        w._incoming("s", "user_message", f"t{i}")
    for _ in range(2):
        nodes = call(w, "GET", "/api/chat/pipeline/s")[1]["nodes"]
        assert [n["tool_id"] for n in nodes] == [f"t{i}" for i in range(60)]
        assert len(frames(call(w, "GET", "/api/agui/stream/s")[1])) > 5
    assert len(asked) == 60
