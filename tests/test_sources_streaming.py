from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from strandline import config
from strandline.plans import graph
from strandline.sources import catalogs, documents, logs, pipelines
from strandline.streaming import sessions


def test_index_and_details(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"http://a/one": {"description": "d", "versions": [["v1", "x"]]}}, indent=1))
    assert [r.app_url for r in catalogs.read_index(spark, str(tmp_path / "index.json")).collect()] == ["http://a/one"]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        catalogs.read_index(spark, str(tmp_path / "bad.json"))
    d = tmp_path / "details"
    (d / "one" / "v1").mkdir(parents=True)
    (d / "one" / "v1" / "metadata.json").write_text(json.dumps({"input": [{"@type": "A"}, [{"@type": "B"}, {"@type": "C"}]], "output": [{"@type": "D", "properties": {"n": 1}}], "parameters": [{"name": "p", "default": 0}]}))
    (d / "two.json").write_text("no json")
    got = {r.app_name: r for r in catalogs.parse_details(catalogs.read_details(spark, str(d))).collect()}
    assert [len(s) for s in got["one"].input] == [1, 2] and got["one"].output[0].properties == {"n": "1"} and got["one"].parameters[0].default == "0" and got["two"].input == []


def test_fetching(spark):
    pages = {"http://s": {"http://s/a": {"versions": [["v2", "x"]]}, "http://s/b": {"versions": []}}, "http://s/a/v2/metadata.json": {"output": [{"@type": "T"}]}}
    index, details = catalogs.fetch_catalog(spark, "http://s", pages.__getitem__)
    assert index.count() == 2 and {r.app_name: len(r.output) for r in details.collect()} == {"a": 1, "b": 0}
    with pytest.raises(KeyError):
        catalogs.fetch_catalog(spark, "http://other", pages.__getitem__)


def test_pipeline_files(spark, tmp_path):
    tools = spark.createDataFrame([("My Pipe", 0, "a", '{"k": [1]}'), ("My Pipe", 1, "b", "{}"), ("Other", 0, "c", "{}")], "pipeline string, i int, tool_id string, data string")
    nodes = graph.add_nodes(tools, ["pipeline"], ["i"])
    edges = graph.add_edges(spark.createDataFrame([("My Pipe", "a-0", "b-1", 0)], "pipeline string, source string, target string, ord long"), ["pipeline"], "ord")
    names, back, links = pipelines.round_trip(spark, nodes.select("pipeline").distinct(), nodes, edges, str(tmp_path))
    assert sorted((r.pipeline, r.id, r.data, r.y) for r in back.collect()) == sorted((r.pipeline, r.id, r.data, r.y) for r in nodes.collect())
    assert [(r.source, r.target) for r in links.collect()] == [("a-0", "b-1")]
    assert [r.name for r in pipelines.list_names(spark, str(tmp_path)).collect()] == ["My Pipe", "Other"]
    assert pipelines.load_one(spark, "my pipe", str(tmp_path)).first().name == "My Pipe"
    assert pipelines.load_one(spark, str(tmp_path / "other.yaml"), "/nowhere").first().name == "Other"
    with pytest.raises(FileNotFoundError):
        pipelines.load_one(spark, "none", str(tmp_path))


def test_logs(spark, tmp_path):
    log = '2025-01-02 03:04:05,678 - INFO - [s1] INCOMING_EVENT: {\n  "type": "user_message",\n  "data": {"message": "hi\\n\\n"}\n}\n2025-01-02 03:04:06,000 - INFO - [s2] WELCOME_REQUEST: {}\n'
    (tmp_path / "a.log").write_text(log)
    rows = logs.read_log(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.session_id, r.log_type) for r in rows] == [("s1", "INCOMING_EVENT"), ("s2", "WELCOME_REQUEST")] and rows[0].log_ts.microsecond == 678000
    events = logs.log_events(logs.read_log(spark, str(tmp_path))).orderBy("ord").collect()
    assert events[0].message == "hi\n\n" and events[1].message is None
    again = logs.read_log(spark, str(tmp_path)).select(F.col("log_ts").alias("at"), "session_id", "log_type", "body")
    logs.append_log(again, str(tmp_path / "out"))
    assert logs.parse_log(spark.read.text(str(tmp_path / "out"), wholetext=True)).count() == 2
    stream = logs.parse_log(logs.follow(spark, str(tmp_path / "out")))
    got = sessions.run_available(stream.select("session_id", "log_type"), "log_follow", "append", str(tmp_path / "cp"))
    assert sorted(r.session_id for r in got.collect()) == ["s1", "s2"]


def test_documents(spark, tmp_path):
    body = json.dumps({"documents": [{"@type": "http://v/VideoDocument/v1", "properties": {"mime": "video/mp4", "id": "d1", "location": "file:///x"}}], "views": []})
    (tmp_path / "x.json").write_text(body)
    assert [r.id for r in documents.document_parts(documents.read_documents(spark, str(tmp_path), "*.json")).collect()] == ["d1"]
    assert documents.path_or_text(spark, str(tmp_path / "x.json")) == body and documents.path_or_text(spark, "{}") == "{}"
    assert documents.first_sample(spark, ["/nowhere", str(tmp_path)], "*.json").endswith("x.json") and documents.first_sample(spark, [str(tmp_path)], "*.none") is None
    e = spark.createDataFrame([("error", {"a": "b"}, "t", "s")], "type string, data map<string,string>, timestamp string, session_id string")
    frame = e.select(documents.sse_frames(e)).first()[0]
    assert frame.startswith("data: {") and frame.endswith("}\n\n") and "\\n\\n" not in frame
    documents.write_frames(e.unionByName(e), str(tmp_path / "frames"))
    assert "".join(p.read_text() for p in (tmp_path / "frames").glob("part-*")) == frame * 2


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert config.load(path) == config.AppConfig()
    changed = config.update(config.AppConfig(), temperature=0.1, cache_dir="x")
    config.save(changed, path)
    assert json.loads((tmp_path / "c.json").read_text())["llm"]["temperature"] == 0.1
    assert config.load(path) == changed and config.load(path, only_model=True).cache_dir == config.AppConfig().cache_dir
    (tmp_path / "c.json").write_text("[")
    assert config.load(path) == config.AppConfig()
    with pytest.raises(KeyError):
        config.update(changed, nothing=1)


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ord"), "role", "text")
    for i in range(3):
        c.filter(F.col("ord") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    src = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    rows = sessions.run_available(sessions.session_stream(src, ttl_ms=None), "stream_equal", "update", str(tmp_path / "cp"))
    want = sessions.session_states(c)
    last = rows.groupBy("session_id").agg(F.max_by(F.struct(*want.columns[1:]), "messages").alias("r")).select("session_id", "r.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_fan_out(spark, tmp_path):
    spark.createDataFrame([("s", 1), ("s", 9), ("t", 9)], "session_id string, at int").write.parquet(str(tmp_path / "in"))
    connections = spark.createDataFrame([("s", 5, "q")], "session_id string, connected_at int, queue string")
    got = []
    src = spark.readStream.schema("session_id string, at int").parquet(str(tmp_path / "in"))
    query = sessions.fan_out(src, lambda: connections, lambda rows, i: got.extend(rows.collect()), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [(r.session_id, r.at, r.queue) for r in got] == [("s", 9, "q")]


def test_timeouts(spark):
    assert sessions.call_with_timeout(spark, lambda: spark.range(5).count(), 60, "g1") == 5
    with pytest.raises(ZeroDivisionError):
        sessions.call_with_timeout(spark, lambda: 1 // 0, 60, "g2")
    with pytest.raises(TimeoutError):
        sessions.call_with_timeout(spark, lambda: time.sleep(3), 0.2, "g3")
