from __future__ import annotations

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.plans import execution, graph, planner
from strandline.plans.registry import Registry, command_tool, echo, from_catalog

RESULTS = "plan_id string, step long, tool_name string, success boolean"


def rows(spark, plans, results):
    p = spark.createDataFrame([(x,) for x in plans], "plan_id string")
    out = execution.progress(p, spark.createDataFrame(results, RESULTS))
    return [(r.seq, r.current_step, r.total_steps, r.step_name, r.status, r.percentage) for r in out.orderBy("plan_id", "seq").collect()]


def test_progress_of_two_steps(spark):
    assert rows(spark, ["p"], [("p", 1, "a", True), ("p", 2, "b", True)]) == [
        (1, 1, 2, "a", "starting", 0.0), (2, 1, 2, "a", "running", 25.0), (3, 1, 2, "a", "completed", 50.0),
        (4, 2, 2, "b", "starting", 50.0), (5, 2, 2, "b", "running", 75.0), (6, 2, 2, "b", "completed", 100.0), (7, 2, 2, "pipeline", "completed", 100.0),
    ]
    assert rows(spark, ["p"], [("p", 1, "a", False), ("p", 2, "b", True)])[2:] == [(3, 1, 2, "a", "failed", 50.0), (4, 2, 2, "pipeline", "failed", 100.0)]
    assert rows(spark, ["p"], []) == [(1, 0, 0, "pipeline", "completed", 100.0)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.booleans(), max_size=5), min_size=1, max_size=4))
def test_progress_properties(spark, plans):
    results = [(f"p{i}", j + 1, f"t{j}", ok) for i, p in enumerate(plans) for j, ok in enumerate(p)]
    out = execution.progress(spark.createDataFrame([(f"p{i}",) for i in range(len(plans))], "plan_id string"), spark.createDataFrame(results, RESULTS)).collect()
    for i, p in enumerate(plans):
        own = sorted((r for r in out if r.plan_id == f"p{i}"), key=lambda r: r.seq)
        assert [r.seq for r in own] == list(range(1, len(own) + 1))
        assert all(a.percentage <= b.percentage for a, b in zip(own, own[1:], strict=False)) and own[-1].percentage == 100.0
        assert sum(r.status == "failed" and r.step_name != "pipeline" for r in own) == (not all(p))
        assert own[-1].status == ("completed" if all(p) else "failed")


def test_validation_and_outcomes(spark):
    plans = spark.createDataFrame([("p",), ("q",)], "plan_id string")
    steps = spark.createDataFrame([("p", 1, "a", True), ("p", 2, "x", True), ("p", 3, "a", True)], RESULTS)
    tools = spark.createDataFrame([("a",)], "tool_name string")
    got = {(r.plan_id, r.step, r.message) for r in execution.validate_plans(plans, steps, tools).collect()}
    assert got == {("p", 2, "Step 2: Tool 'x' not available"), ("q", 0, "Pipeline has no steps")}
    results = execution.step_results(steps, tools)
    assert results.filter("step = 2").first().error == "Tool x not found"
    ends = {r.plan_id: (r.success, r.failed_steps, r.n_run) for r in execution.plan_outcomes(plans, results).collect()}
    assert ends == {"p": (False, "x", 2), "q": (True, "", 0)}
    broke = execution.planning_error(plans, F.lit(3)).first()
    assert (broke.current_step, broke.total_steps, broke.status, broke.percentage) == (0, 3, "failed", 0.0)


def test_status(spark):
    cases = [(False, True, 0, None, None, "planned"), (True, False, 0, None, None, "planned"), (True, True, 1, None, None, "validation_failed"), (True, True, 0, "completed", None, "completed"), (True, True, 0, "failed", None, "execution_failed"), (True, True, 0, None, None, "execution_failed"), (True, True, 0, None, "x", "error")]
    df = spark.createDataFrame([c[:5] for c in cases], "a boolean, i boolean, n int, l string, e string")
    got = [r[0] for r in df.select(execution.request_status(F.col("a"), F.col("i"), F.col("n"), F.col("l"), F.col("e"))).collect()]
    assert got == [c[5] for c in cases]


def test_classifier(spark):
    queries = {"Transcribe this": ["whisper-wrapper"], "ocr of VISUAL text": ["easyocr-wrapper"], "scene list": ["swt-detection"], "audio and text by shot": ["whisper-wrapper", "easyocr-wrapper", "swt-detection"], "hello": ["whisper-wrapper"], "a thread": ["easyocr-wrapper"]}
    df = spark.createDataFrame(list(enumerate(queries)), "request_id long, query string")
    got = {r.query: r for r in planner.plan_requests(df).collect()}
    for q, tools in queries.items():
        assert [s.tool_name for s in got[q].plan.steps] == tools and got[q].plan.estimated_total_time == 60 * len(tools) and got[q].plan.confidence == 0.5
    assert got["hello"].plan.steps[0].reasoning == "General audio analysis" and got["scene list"].plan.steps[0].reasoning == "Detect scenes and segments"


def test_planners(spark):
    df = spark.createDataFrame([(1, "speech"), (2, "speech"), (3, "speech")], "request_id long, query string")
    good = json.dumps({"steps": [{"tool_name": "t", "parameters": {"k": "v"}, "config": "c"}, {}], "reasoning": "r", "confidence": 7.0, "input_types": [], "output_types": ["o"], "estimated_time": 5})

    def model(requests):
        return requests.select("request_id", F.when(F.col("request_id") == 1, good).when(F.col("request_id") == 2, '{"steps": []}').alias("output"), F.when(F.col("request_id") == 3, "timeout").alias("error"))

    got = {r.request_id: r.plan for r in planner.plan_requests(df, model).collect()}
    assert got[1].confidence == 7.0 and got[1].steps[0].parameters == {"k": "v"} and (got[1].steps[1].tool_name, got[1].steps[1].estimated_time) == ("", 30)
    assert got[2].reasoning == "Fallback plan for: speech"
    assert got[3].confidence == 0.1 and got[3].estimated_total_time == 60 and "timeout" in got[3].steps[0].reasoning


def test_running_tools(spark):
    registry = Registry().add("echo", echo, ("a",), ("b",)).add("bad", lambda v, p: 1 / 0).add("err", lambda v, p: '{"error": null}').add("upper", lambda v, p: v.upper())
    plans = spark.createDataFrame([("p", "in"), ("q", "in"), ("r", "in"), ("s", "in")], "plan_id string, input string")
    steps = [("p", 1, "upper", {}), ("p", 2, "echo", {"k": "v"}), ("q", 1, "bad", {}), ("q", 2, "upper", {}), ("r", 1, "gone", {}), ("r", 2, "upper", {})]
    out = execution.run_plans(plans, spark.createDataFrame(steps, "plan_id string, step long, tool_name string, parameters map<string,string>"), registry)
    got = {(r.plan_id, r.step): (r.success, r.output, r.error) for r in out.collect()}
    assert got == {("p", 1): (True, "IN", None), ("p", 2): (True, '{"text": "IN", "k": "v"}', None), ("q", 1): (False, None, "division by zero"), ("r", 1): (False, None, "Tool gone not found")}
    ends = {r.plan_id: r.output for r in execution.final_outputs(plans, out).collect()}
    assert ends == {"p": '{"text": "IN", "k": "v"}', "q": None, "r": None, "s": "in"}
    assert registry.call("err", "x", {})[0] is False
    assert registry.table(spark).count() == 4


def test_command_tools():
    assert command_tool(["cat"])("hello", {}) == "hello"
    assert "error" in json.loads(command_tool(["false"])("", {}))
    assert "timeout" in json.loads(command_tool(["sleep", "5"], timeout=1)("", {}))["error"]


def test_registry_of_a_catalog(spark):
    df = spark.createDataFrame([(1, "b"), (0, "a")], "ord long, app_name string")
    assert list(from_catalog(df, lambda name: echo).tools) == ["a", "b"]


def test_graph(spark):
    tools = spark.createDataFrame([("p", i, t, "{}") for i, t in enumerate(["a", "b", "a"])], "pipeline string, i int, tool_id string, data string")
    nodes = graph.add_nodes(tools, ["pipeline"], ["i"])
    assert [(r.id, r.x, r.y) for r in nodes.orderBy("ord").collect()] == [("a-0", 100.0, 0.0), ("b-1", 100.0, 100.0), ("a-2", 100.0, 200.0)]
    asked = spark.createDataFrame([("p", "a-0", "b-1", 1), ("p", "a-0", "b-1", 2), ("p", "b-1", "zz", 3)], "pipeline string, source string, target string, ord long")
    edges = graph.add_edges(asked, ["pipeline"], "ord")
    assert sorted((r.id, r.ord) for r in edges.collect()) == [("a-0-b-1", 1), ("b-1-zz", 3)]
    assert graph.add_edges(edges.drop("id"), ["pipeline"], "ord").count() == 2
    assert [r.source_tool for r in graph.displayed_edges(edges, nodes).collect()] == ["a"]
    one = graph.to_struct(spark.createDataFrame([("p",), ("empty",)], "pipeline string"), nodes, edges)
    names, back, links = graph.from_struct(one)
    assert sorted(r.pipeline for r in names.collect()) == ["empty", "p"]
    assert sorted((r.ord, r.id, r.y) for r in back.collect()) == sorted((r.ord, r.id, r.y) for r in nodes.collect()) and links.count() == 2
    unnamed = graph.from_struct(one.withColumn("name", F.lit(None).cast("string")))[0].first().pipeline
    assert unnamed == "Imported Pipeline"
    assert graph.clear_pipelines(nodes, names.filter("pipeline = 'p'")).count() == 0


def test_nodes_of_conversations(spark):
    e = spark.createDataFrame([("s", 1, "tool_selected", "x"), ("s", 2, "assistant_message", None), ("s", 3, "tool_selected", ""), ("s", 4, "tool_selected", "y")], "session_id string, ord long, type string, tool_name string")
    assert [(r.pipeline, r.id) for r in graph.from_tool_events(e).orderBy("ord").collect()] == [("Pipeline-s", "x-0"), ("Pipeline-s", "y-1")]


def test_plans_run_over_as_many_partitions_as_asked(spark):
    plans = spark.createDataFrame([(f"p{i}", str(i)) for i in range(40)] + [("none", "x"), (None, "x")], "plan_id string, input string")
    rows = [(f"p{i}", s, "echo" if s != 3 or i % 2 else "lost", {"s": str(s)}) for i in range(40) for s in (1, 2, 3, 4)] + [("unknown", 1, "echo", {}), (None, 1, "echo", {})]
    steps = spark.createDataFrame(rows, "plan_id string, step long, tool_name string, parameters map<string,string>").repartition(3)
    out = execution.run_plans(plans, steps, Registry().add("echo", echo), 11)
    assert out.rdd.getNumPartitions() == 11
    got = {(r.plan_id, r.step): r.success for r in out.collect()}
    assert got == {(f"p{i}", s): i % 2 == 1 or s < 3 for i in range(40) for s in ((1, 2, 3, 4) if i % 2 else (1, 2, 3))}
