from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from strandline.operators import catalog, compat, events, lookups, sequences
from strandline.schemas import CATALOG
from strandline.sources import catalogs

INDEX = {
    "http://apps/one": {"description": "first", "latest_update": "2024-01-01T00:00:00+00:00", "versions": [["v7.5", "x"], ["v7.4", "x"]]},
    "http://apps/two": {"description": "second", "latest_update": "2024-01-02T00:00:00+00:00", "versions": [["v1.0", "y"]]},
    "http://apps/bare": {"description": "", "versions": []},
}
DETAILS = {
    "one": {"name": "One", "input": [{"@type": "http://v/VideoDocument/v1", "required": True}], "output": [{"@type": "http://v/TimeFrame/v1", "properties": {"timeUnit": "ms", "labelset": ["a", "b"]}}], "parameters": [{"name": "p", "type": "boolean", "default": False}]},
    "two": {"input": [[{"@type": "http://v/TimeFrame/v2"}, {"@type": "http://w/X"}]], "output": [{"@type": "http://v/TextDocument/v1"}], "parameters": []},
}


@pytest.fixture(scope="module")
def tools(spark):
    return catalog.shape_catalog(catalogs.index_frame(spark, INDEX), catalogs.detail_frame(spark, DETAILS)).cache()


def test_catalog(tools):
    rows = {r.app_name: r for r in tools.collect()}
    assert [r.app_name for r in tools.orderBy("ord").collect()] == ["one", "two", "bare"]
    assert (rows["one"].latest_version, rows["two"].latest_version, rows["bare"].latest_version) == ("v7.5", "v1.0", "unknown")
    assert len(rows["one"].input) == len(rows["one"].output) == len(rows["one"].parameters) == 1 and rows["bare"].input == []
    assert rows["one"].parameters[0].default == "false" and rows["one"].output[0].properties["labelset"] == '["a", "b"]'
    assert catalog.pick_app(tools, "two").count() == 1 and catalog.pick_app(tools, "none").count() == 0
    view = {r.app_name: (r.input_types, r.output_types) for r in catalog.planning_view(tools).collect()}
    assert view["one"] == (["VideoDocument"], ["TimeFrame"]) and view["two"] == ([], ["TextDocument"])
    legacy = {r.app_name: (r.input_types, r.output_types) for r in catalog.planning_view(tools, "legacy").collect()}
    assert legacy["one"] == ([], [])
    lines = {r.app_name: r.line for r in catalog.tool_lines(tools).collect()}
    assert lines["bare"] == "- bare: \n  Input: Any | Output: Various"
    about = {r.app_name: r.description for r in catalog.describe_tools(tools).collect()}
    assert about["bare"].startswith("Tool for video analysis.")
    wanted = tools.sparkSession.createDataFrame([(0, "two"), (1, "no"), (2, "one"), (3, "two")], "place long, app_name string")
    assert sorted((r.place, r.app_name) for r in lookups.wanted_and_available(wanted, tools).collect()) == [(0, "two"), (2, "one"), (3, "two")]


def test_palette_and_health(spark, tools):
    df = spark.createDataFrame([(1, "b"), (2, "A"), (3, None), (4, "a"), (5, "B")], "ord long, app_name string")
    assert [r.app_name for r in catalog.palette(df).orderBy("rank").collect()] == [None, "a", "A", "b", "B"]
    r = catalog.health(tools=tools, store=None).first()
    assert r.tools_count == 3 and r.tools_available and not r.store_available and r.store_count is None and r.status == "healthy"
    with pytest.raises(ValueError, match="session"):
        catalog.health(store=None)


def test_connections_of_a_catalog(spark, tools):
    edges = spark.createDataFrame([("one", "two"), ("two", "one"), ("one", "gone")], "source_tool string, target_tool string")
    got = {(r.source_tool, r.target_tool): r.edge_type for r in compat.valid_connections(edges, tools).collect()}
    assert got == {("one", "two"): "default", ("two", "one"): "invalid"}


def test_suggestions(spark):
    tools = [("a", ["TextDocument", "TimeFrame"], ["VideoDocument"]), ("b", [], ["textdocument", "alignment"]), ("c", [], ["NamedEntity"]), ("d", [], ["timeframe"]), ("e", [], ["Other"])]
    outs = spark.createDataFrame([(n, i, t) for n, o, _ in tools for i, t in enumerate(o)], "tool string, out_ord int, out_type string")
    ins = spark.createDataFrame([(n, k, t) for k, (n, _, i) in enumerate(tools) for t in i], "tool string, ord int, in_type string")
    last = spark.createDataFrame([("a",), ("zz",), ("e",)], "last string")
    rules = compat.rule_table(spark)

    def answer(**options):
        out = {}
        for r in compat.suggest_next(last, outs, ins, rules, **options).orderBy("last", "rank").collect():
            out.setdefault(r.last, []).append(r.tool)
        return out

    # 'b' fits both outputs of 'a', so it takes two places
    assert answer() == {"a": ["b", "b", "c", "d"], "zz": list(compat.STARTERS)}
    assert answer(repeats=False)["a"] == ["b", "c", "d"] and answer(k=2)["a"] == ["b", "b"]
    pairs = {(r.source, r.target) for r in compat.compatible_pairs(outs.withColumnRenamed("tool", "t"), ins.withColumnRenamed("tool", "t"), rules, "t").collect()}
    assert pairs == {("a", "b"), ("a", "c"), ("a", "d")}
    many = compat.rule_table(spark, {f"k{i}": ("x",) for i in range(10_001)})
    far = spark.createDataFrame([("src", "K10000"), ("other", "none")], "tool string, out_type string")
    assert [tuple(r) for r in compat.compatible_pairs(far, spark.createDataFrame([("dst", "X")], "tool string, in_type string"), many).collect()] == [("src", "dst")]


def test_sequences(spark):
    df = spark.createDataFrame([("p", 1, True, "a"), ("p", 2, False, "b"), ("p", 3, True, "a"), ("q", 1, None, "c")], "k string, i int, ok boolean, v string")
    ran = sequences.until_first_failure(df, ["k"], ["i"], F.col("ok"))
    assert sorted((r.k, r.i) for r in ran.collect()) == [("p", 1), ("p", 2), ("q", 1)]
    seen = {r.k: r.seen for r in sequences.distinct_first_seen(df, ["k"], "v", F.col("i"), "seen").collect()}
    assert seen == {"p": ["a", "b"], "q": ["c"]}
    assert sorted((r.k, r.i) for r in sequences.insert_if_absent(df, ["k", "v"], "i").collect()) == [("p", 1), ("p", 2), ("q", 1)]
    last = {r.v: (r.i, r.ok) for r in sequences.last_wins(df.select("v", "i", "ok"), "v", "i").collect()}
    assert last["a"] == (1, True)
    chain = df.select("k", "i", sequences.previous(F.col("v"), ["k"], ["i"], F.lit("seed")).alias("p"))
    assert [r.p for r in chain.orderBy("k", "i").collect()] == ["seed", "a", "b", "seed"]
    assert df.filter("false").agg(sequences.all_true("ok")).first()[0] is True
    assert df.agg(sequences.joined_in_order("i", "v", "+")).first()[0] in {"a+c+b+a", "c+a+b+a"}
    first, more = sequences.head_and_more(df, ["k", "i"], 3)
    assert first.count() == 3 and more.first().more == 1
    assert df.groupBy("k").agg(sequences.last_value_by("v", "i").alias("v")).filter("k = 'p'").first().v == "a"


def test_heartbeats(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [("s", i, at + datetime.timedelta(seconds=x)) for i, x in enumerate((0, 29, 59, 180))]
    got = sequences.heartbeats(spark.createDataFrame(rows, "k string, i int, t timestamp"), ["k"], "t", "i")
    assert [r.beats for r in got.orderBy("i").collect()] == [0, 1, 4, 0]


def test_lookups(spark):
    tools = spark.createDataFrame([("x-wrapper",), ("y",), ("z",)], "tool_name string")
    places = spark.createDataFrame([("app-x", "/1", True), ("x-wrapper", "/2", True), ("app-y", "/3", False), ("y", "/4", True)], "directory string, path string, has_app boolean")
    assert {r.tool_name: r.path for r in lookups.find_directories(tools, places).collect()} == {"x-wrapper": "/1", "y": "/4", "z": None}
    e = spark.createDataFrame([("s", 1), ("s", 5), ("t", 9)], "session_id string, at int")
    c = spark.createDataFrame([("s", 0, "old"), ("s", 3, "new")], "session_id string, connected_at int, queue string")
    assert [(r.at, r.queue) for r in lookups.latest_connection(e, c).collect()] == [(5, "new")]
    assert lookups.broadcast_events(e, c).count() == 3
    assert sorted(map(tuple, lookups.broadcast_events(e, e, most_sessions=1).collect())) == sorted((at, s) for at in (1, 5, 9) for s in "st")


def test_responses(spark):
    messages = spark.createDataFrame([("s", 1, None), ("s", 2, "broke")], "session_id string, ord long, failed string")
    updates = spark.createDataFrame([("s", 1, 1, "assistant_message", "hi"), ("s", 1, 2, "conversation_complete", "completed")], "session_id string, message_ord long, ord long, type string, content string")

    def kinds(**options):
        return [(r.message_ord, r.type) for r in events.responses(messages, updates, **options).orderBy("message_ord", "seq").collect()]

    assert kinds() == [(1, "text_message_content"), (1, "run_started"), (1, "text_message_content"), (1, "run_finished"), (1, "run_finished"), (2, "run_started"), (2, "run_error"), (2, "run_finished")]
    assert kinds(dedupe_terminal=True).count((1, "run_finished")) == 1


def test_flags_and_cap(spark):
    e = spark.createDataFrame([("s", i, a) for i, a in enumerate(["x", "start", "x", "text", "end", "start", "error"])], "k string, i int, a string")
    got = events.ui_flags(e, ["k"], ["i"], F.col("a")).orderBy("i").collect()
    assert [(r.streaming, r.loading) for r in got] == [(False, False), (True, True), (True, True), (False, True), (False, False), (True, True), (False, False)]
    assert [r.i for r in events.capped(e, ["k"], ["i"], 2).collect()] == [0, 1]
    fine, bad = events.with_message(spark.createDataFrame([("a",), ("",), (None,)], "message string"))
    assert fine.count() == 1 and bad.count() == 2


def test_snapshot(spark, tools, tmp_path):
    for form in ("parquet", "json"):
        catalogs.write_snapshot(tools, str(tmp_path / form), form)
        assert sorted(map(str, catalogs.read_snapshot(spark, str(tmp_path / form), form).select(*[f.name for f in CATALOG]).collect())) == sorted(map(str, tools.select(*[f.name for f in CATALOG]).collect()))


def test_partitions_grow_with_the_rows(spark, sf_dir, monkeypatch):
    from strandline import queries

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sequences.parts_for(spark, 10) == least and sequences.parts_for(spark, 10 * least + 1, 10) == least + 1
    df = spark.range(5000).select((F.col("id") % 500).alias("k"), "id")
    assert sequences.dealt(df, ["k"], 5000) is df
    dealt = sequences.dealt(df, ["k"], 5000, 100)
    parts = dealt.withColumn("part", F.spark_partition_id()).groupBy("k").agg(F.countDistinct("part").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert dealt.rdd.getNumPartitions() == 50 and parts.filter("n = 1 AND rows = 10").count() == 500

    before = queries._steps(spark, sf_dir).select("l_orderkey", "l_linenumber", "step").collect()
    monkeypatch.setattr(sequences, "ROWS_OF_A_TASK", 100)
    steps, results = queries._steps(spark, sf_dir), queries._plans(spark, sf_dir, 40)[1]
    assert steps.rdd.getNumPartitions() == results.rdd.getNumPartitions() == -(-len(before) // 100)
    assert sorted(steps.select("l_orderkey", "l_linenumber", "step").collect()) == sorted(before)
