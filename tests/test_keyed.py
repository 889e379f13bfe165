"""State across batches and restarts, against plain folds."""

from __future__ import annotations

import json
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from strandline.plans.agents import updates_of
from strandline.plans.registry import Registry
from strandline.streaming import keyed, sessions


def batches(spark, path, parts, schema, make, mode="append"):
    """Each part written and run over from the same checkpoint, so every part but the first follows a restart."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        out = sessions.run_available(make(spark.readStream.schema(schema).parquet(f"{path}/in")), f"q{i}", mode, f"{path}/cp")
    return [tuple(r) for r in out.collect()]


EVENTS = "session_id string, ord long, role string, text string"


def test_memory_over_restarts(spark, tmp_path):
    parts = [
        [("a", 2, "assistant", "y"), ("a", 1, "user", "x"), ("b", 1, "system", None)],
        [("a", 2, "assistant", "y"), ("a", 3, "user", "z"), ("b", 2, "user", "é")],  # one row comes again
        [("b", 3, "user", ""), ("a", 9, "user", "end"), ("a", 8, "assistant", "late in its batch")],
    ]
    got = batches(spark, str(tmp_path), parts, EVENTS, keyed.remembered)
    rows = {(s, o): (t, first, [tuple(h) for h in history]) for s, o, _, t, first, history in got}
    assert len(got) == len(rows) == 5
    assert rows["a", 1] == ("x", True, [])
    assert rows["a", 3] == ("z", False, [(1, "user", "x"), (2, "assistant", "y")])
    assert [h[0] for h in rows["a", 9][2]] == [1, 2, 3, 8]
    assert rows["b", 2] == ("é", True, [(1, "system", None)]) and not rows["b", 3][1]


def test_memory_is_forgotten_when_idle(spark, tmp_path):
    """Timers of processing time keep a run going, so this one is stopped when the second message has its row."""
    made = []
    spark.createDataFrame([("a", 1, "user", "x")], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = keyed.remembered(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), idle_ms=1)
    query = rows.writeStream.foreachBatch(lambda b, i: made.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="100 milliseconds").start()
    try:
        until = time.monotonic() + 90
        while query.isActive and time.monotonic() < until and len(made) < 1:
            time.sleep(0.1)
        seen = query.lastProgress.batchId
        while query.isActive and time.monotonic() < until and query.lastProgress.batchId < seen + 3:  # the timer's batch has ended
            time.sleep(0.1)
        spark.createDataFrame([("a", 2, "user", "z")], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        while query.isActive and time.monotonic() < until and len(made) < 2:
            time.sleep(0.1)
    finally:
        query.stop()
    assert [(r.ord, r.first, len(r.history)) for r in made] == [(1, True, 0), (2, True, 0)]


def test_agent_remembers_and_calls_tools(spark, tmp_path):
    def model(said: list[dict]) -> str:
        if said[-1]["role"] == "tool":
            return "it says " + said[-1]["content"]
        earlier = [m["content"] for m in said if m["role"] in ("user", "assistant")][:-1]
        return json.dumps({"tool": "shout", "input": said[-1]["content"]}) if "!" in said[-1]["content"] else f"after {earlier}"

    answer = updates_of(model, Registry().add("shout", lambda value, parameters: value.upper()))
    got = batches(spark, str(tmp_path), [[("s", 1, "hi"), ("t", 1, "ho")], [("s", 2, "go!")], [("s", 3, "end")]], "session_id string, ord long, text string", lambda m: keyed.conversation(m, answer))
    said = {(s, m): content for s, m, _, kind, content, _ in got if kind == "assistant_message"}
    assert said == {("s", 1): "after []", ("t", 1): "after []", ("s", 2): "it says GO!", ("s", 3): "after ['hi', 'after []', 'go!', 'it says GO!']"}
    assert [r[5] for r in got if r[3] == "tool_selected"] == ["shout"]


@pytest.fixture(params=["UTC", "Asia/Tokyo", "America/New_York"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_delivery_to_the_connection_of_the_time(spark, tmp_path, zone):
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    rows = [  # session, second, seq, queue (connection) or None (event), batch
        ("a", 1, 1, None, 0), ("a", 2, 2, "q1", 0), ("a", 3, 3, None, 0), ("b", 5, 4, None, 0),
        ("b", 4, 5, "q3", 1), ("a", 3, 6, "q2", 1), ("a", 9, 7, None, 1), ("a", 3, 8, None, 1),
        ("a", 30, 9, "q4", 2), ("a", 30, 10, None, 2), ("z", 999, 11, "close", 2),
    ]
    schema = "session_id string, at timestamp, seq long, queue string"
    parts = [[(s, at(t), n, q) for s, t, n, q, b in rows if b == i] for i in range(3)]
    parts[1].append(("a", None, 12, None))  # at no time
    make = lambda both: keyed.deliver(both.filter("queue IS NULL"), both.filter("queue IS NOT NULL"), "60 seconds")
    got = batches(spark, str(tmp_path), parts, schema, make)
    want, open_queue = [], defaultdict(lambda: None)
    for s, _, n, q, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if q is not None:
            open_queue[s] = q
        elif open_queue[s] is not None:
            want.append((s, n, open_queue[s]))
    assert sorted(got) == sorted(want) and len(want) == 5


def test_caps_count_across_batches(spark, tmp_path):
    parts = [[("a", 3, "z"), ("a", 1, "x"), ("b", 1, "p")], [("a", 4, "w"), ("a", 5, "v"), ("b", 2, "q")], [("a", 6, "u")]]
    got = batches(spark, str(tmp_path), parts, "session_id string, ord long, frame string", lambda f: keyed.capped_stream(f, 3))
    assert sorted(got) == [("a", 1, "x"), ("a", 3, "z"), ("a", 4, "w"), ("b", 1, "p"), ("b", 2, "q")]
