"""A catalog loaded in parallel, and files that appear all or none."""

from __future__ import annotations

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from strandline.operators.catalog import pick_app
from strandline.sources import pipelines
from strandline.sources.catalog_source import catalog_table, entries
from strandline.sources.named_files import write_files
from strandline.sources.paths import files_below


@pytest.fixture
def server():
    index = {f"http://x/app{i}": {"description": f"d{i}", "versions": [[f"v{i}", "a"]] if i % 4 else []} for i in range(20)}
    asked: Counter = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            asked[self.path] += 1
            parts = self.path.strip("/").split("/")
            fine = len(parts) == 1 or parts[1] != "app7"
            body = json.dumps(index if len(parts) == 1 else {"output": [{"@type": parts[1]}], "parameters": [{"name": "p", "default": 0}]}) if fine else "no json"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args) -> None:
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/c", asked
    http.shutdown()


def test_parallel_load_and_pushed_names(spark, server):
    base, asked = server
    table = catalog_table(spark, base, group=6)
    assert table.rdd.getNumPartitions() == 4
    asked.clear()
    rows = {r.app_name: r for r in table.collect()}
    assert len(rows) == 20 and rows["app4"].latest_version == "unknown" and rows["app5"].latest_version == "v5" and rows["app5"].output[0].type == "app5" and rows["app5"].parameters[0].default == "0"
    assert rows["app7"].output == [] and rows["app7"].description == "d7"
    assert sum(asked.values()) == 20 + asked["/c"]
    asked.clear()
    assert [r.ord for r in pick_app(table, "app3").collect()] == [3]
    assert {k for k in asked if k != "/c"} == {"/c/app3/v3/metadata.json"} and asked["/c/app3/v3/metadata.json"] == 1
    asked.clear()
    assert sorted(r.ord for r in table.filter(F.col("app_name").isin("app1", "app2", "none")).filter("ord > 1").collect()) == [2]
    assert sum(v for k, v in asked.items() if k != "/c") == 2
    assert pick_app(table, "none").collect() == []
    asked.clear()
    assert catalog_table(spark, base, details=False).filter("description > 'd5'").count() == 4 and set(asked) == {"/c"}


def test_repeated_names_and_bad_indexes(spark, tmp_path):
    assert entries({"http://a/x": {"description": "1"}, "http://a/y": {}, "http://b/x": {"description": "2", "versions": [["v2", ""]]}}) == [(0, "x", "v2", "2"), (1, "y", "unknown", "")]
    (tmp_path / "index.json").write_text("[]")
    with pytest.raises(Exception, match="JSON object"):
        catalog_table(spark, str(tmp_path)).collect()


def test_files_appear_all_or_none(spark, tmp_path):
    folder = tmp_path / "out"
    write_files(spark.createDataFrame([(f"d{i % 3}/f{i}.txt", f"é{i}") for i in range(40)], "name string, body string").repartition(5), str(folder))
    assert sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file()) == sorted(f"d{i % 3}/f{i}.txt" for i in range(40))
    assert (folder / "d1" / "f7.txt").read_text() == "é7"
    write_files(spark.createDataFrame([("d1/f7.txt", None)], "name string, body string"), f"file://{folder}")
    assert (folder / "d1" / "f7.txt").read_text() == ""
    shown = lambda: [f for f, _ in files_below(str(folder))]
    before = shown()
    for bad in ("../out.txt", "/x", "", None):  # one task fails, the others have written
        rows = spark.createDataFrame([(f"new{i}", "x") for i in range(20)], "name string, body string").unionByName(spark.createDataFrame([(bad, "x")], "name string, body string"))
        with pytest.raises(Exception, match="not a file's name"):
            write_files(rows, str(folder))
        assert shown() == before


def test_pipelines_of_one_file_name(spark, tmp_path):
    rows = [("my ocr", [("a-0", "a", "{}", 1.0, 2.0)], []), ("My Ocr", [], []), ("other", [], [("e", "s", "t")])]
    df = spark.createDataFrame(rows, "name string, nodes array<struct<id:string,tool_id:string,data:string,x:double,y:double>>, edges array<struct<id:string,source:string,target:string>>")
    files = pipelines.save(df, str(tmp_path))
    assert {r.file for r in files.collect()} == {"my_ocr.yaml", "other.yaml"}
    got = {r.name: r for r in pipelines.read_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"my ocr", "other"} and got["my ocr"].nodes[0].x == 1.0 and got["other"].edges[0].target == "t"


def test_few_pipelines_at_a_time_are_python_objects(monkeypatch):
    import pandas as pd
    import pyarrow as pa

    made = []
    dump, load = pipelines.dump, pipelines.load
    monkeypatch.setattr(pipelines, "dump", lambda p: made.append(1) or dump(p))
    monkeypatch.setattr(pipelines, "load", lambda t: made.append(1) or load(t))
    nodes = [{"id": "a-0", "tool_id": "a", "data": '{"k": "\U0001f600"}', "x": 1.0, "y": None}]
    rows = [{"file": f"p{i}.yaml", "name": f"p {i}", "nodes": nodes, "edges": []} for i in range(3 * pipelines.FEW + 1)]
    texts = pipelines.file_texts(iter([pa.RecordBatch.from_pylist(rows)]))
    first = next(texts)
    assert len(made) == first.num_rows == pipelines.FEW
    files = [r for b in [first, *texts] for r in b.to_pylist()]
    assert [f["name"] for f in files] == [r["file"] for r in rows]
    made.clear()
    back = pipelines.parsed(iter([pd.DataFrame({"value": [f["body"].replace("null", "2.5") for f in files]})]))
    first = next(back)
    assert len(made) == len(first) == pipelines.FEW
    got = pd.concat([first, *back])
    assert list(got["name"]) == [r["name"] for r in rows] and got["nodes"].iloc[-1][0]["y"] == 2.5 and "\U0001f600" in json.loads(got["nodes"].iloc[-1][0]["data"])["k"]
