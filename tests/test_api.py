from __future__ import annotations

from pyspark.sql import functions as F

from strandline.api import Service
from strandline.operators.catalog import shape_catalog
from strandline.plans import graph
from strandline.plans.registry import Registry
from strandline.sources import catalogs

INCOMING = "session_id string, ord long, type string, message string, item string, approved boolean, comments string"


def agent(messages):
    rows = F.array(
        F.struct(F.lit(1).cast("long").alias("ord"), F.lit("assistant_message").alias("type"), F.concat(F.lit("re: "), "message").alias("content"), F.lit(None).cast("string").alias("tool_name")),
        F.struct(F.lit(2).cast("long").alias("ord"), F.lit("tool_selected").alias("type"), F.lit(None).cast("string").alias("content"), F.lit("ocr").alias("tool_name")),
        F.struct(F.lit(3).cast("long").alias("ord"), F.lit("conversation_complete").alias("type"), F.lit("completed").alias("content"), F.lit(None).cast("string").alias("tool_name")),
    )
    return messages.select("session_id", "message_ord", F.explode(rows).alias("u")).select("session_id", "message_ord", "u.*")


def service(spark, folder, registry=None):
    index = {"http://a/ocr": {"description": "reads", "versions": [["v1", "x"]]}}
    return Service(spark, shape_catalog(catalogs.index_frame(spark, index), catalogs.detail_frame(spark, {"ocr": {}})), str(folder), agent, registry or Registry())


def test_answers(spark, tmp_path):
    s = service(spark, tmp_path)
    rows = [("s", 1, "session_start", None, None, None, None), ("s", 2, "user_message", "hi", None, None, None), ("s", 3, "user_message", "", None, None, None), ("s", 4, "validation_request", None, "x", None, None), ("s", 5, "human_feedback", None, None, True, "ok"), ("s", 6, "odd", None, None, None, None)]
    incoming = spark.createDataFrame(rows, INCOMING)
    got = [(r.ord, r.type) for r in s.answer(incoming).orderBy("ord", "seq").collect()]
    assert got == [
        (1, "custom_event"), (2, "text_message_content"), (2, "run_started"), (2, "text_message_content"), (2, "tool_call_start"), (2, "run_finished"), (2, "run_finished"),
        (3, "run_error"), (4, "custom_event"), (4, "text_message_content"), (5, "text_message_content"), (5, "state_delta"), (6, "raw_event"),
    ]
    assert s.stream(incoming, 3).count() == 3
    assert s.welcome(incoming.select("session_id").distinct()).first().content == "Session started successfully"
    chat = s.chat(incoming.filter("type = 'user_message'")).first()
    assert (chat.content, chat.tool_calls, chat.updates, chat.tool_added) == ("re: hi", ["ocr"], 3, True)
    asked = spark.createDataFrame([("s",), ("t",)], "session_id string")
    assert {(r.session_id, r.pipeline, r.status) for r in s.session_pipelines(incoming, asked).collect()} == {("s", "Pipeline-s", "found"), ("t", None, "no session")}


def test_tools_pipelines_health(spark, tmp_path):
    s = service(spark, tmp_path)
    assert s.tools().first().description.startswith("Tool for reads.") and s.health().first().tools_count == 1
    nodes = graph.from_tool_events(spark.createDataFrame([("s", 1, "tool_selected", "ocr")], "session_id string, ord long, type string, tool_name string")).withColumn("data", F.lit("{}"))
    edges = spark.createDataFrame([], "pipeline string, ord long, id string, source string, target string")
    s.export(nodes, edges, "s", "My Work")
    assert [r.name for r in s.list_pipelines().collect()] == ["My Work"] and s.pipeline("My Work").first().nodes[0].id == "ocr-0"


def test_requests(spark, tmp_path):
    registry = Registry().add("whisper-wrapper", lambda v, p: v + "!").add("easyocr-wrapper", lambda v, p: '{"error": "x"}')
    s = service(spark, tmp_path, registry)
    requests = spark.createDataFrame([(1, "speech", "in"), (2, "read", "in"), (3, "scene", "in"), (4, "speech", None)], "request_id long, query string, input string")
    plans, results = s.process(requests, auto_execute=True)
    assert {r.request_id: r.status for r in plans.collect()} == {1: "completed", 2: "execution_failed", 3: "validation_failed", 4: "planned"}
    assert {(r.plan_id, r.output) for r in results.collect()} == {("1", "in!"), ("2", None)}
    plans, results = s.process(requests)
    assert {r.status for r in plans.collect()} == {"planned"} and results.count() == 0
