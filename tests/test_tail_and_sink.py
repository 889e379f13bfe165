"""Growing logs and frames as streams, and the sink that a batch reaches once."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.session import workers_import
from strandline.sources import frame_sink, tail
from strandline.streaming import sessions


def record(i: int, text: str, pretty: bool = True) -> str:
    body = json.dumps({"type": "user_message", "data": {"message": text}}, indent=2 if pretty else None, ensure_ascii=False)
    return f"2025-01-02 03:04:{i % 60:02d},{i % 1000:03d} - INFO - [s{i % 3}] INCOMING_EVENT: {body}\n"


@pytest.mark.parametrize("kind", ["log", "frames"])
@pytest.mark.parametrize("chunk", [1, 7, 100, 10_000])
def test_ranges_give_each_record_once(tmp_path, kind, chunk):
    rnd = random.Random(chunk)
    texts = ["", "x" * 50, "é ß\n\\n", "a: {", "2025-01-02", " "] * 4
    rnd.shuffle(texts)
    records = [record(i, t, i % 2 == 0) if kind == "log" else f"data: {json.dumps({'t': t})}\n\n" for i, t in enumerate(texts)]
    (tmp_path / "a.log").write_text("".join(records))
    source = tail._Tail({"path": str(tmp_path), "kind": kind, "chunk": str(chunk)})
    got = [row for r in source.ranges({}, source.ends()) for row in source.rows(r)]
    assert [g[2] for g in got] == records
    places = [0]
    for r in records:
        places.append(places[-1] + len(r.encode()))
    assert [g[1] for g in got] == places[:-1]


def test_small_steps_find_records(tmp_path):
    whole = "".join(record(i, "t" * i) for i in range(12)).encode()
    read = lambda start, size: whole[start : start + size]
    got = [r for start in range(0, len(whole), 97) for r in tail._records(read, tail.Range("f", start, min(start + 97, len(whole)), len(whole)), "log", step=13)]
    assert b"".join(r for _, r in got) == whole and len(got) == 12


def test_small_files_and_ranges_share_tasks(spark, tmp_path):
    records = [[record(i, f"f{k} " + "t" * (i * 7 % 90)) for i in range(20)] for k in range(300)]
    for k, rs in enumerate(records):
        (tmp_path / f"f{k:03d}.log").write_text("".join(rs))
    source = tail.TailBatch({"path": str(tmp_path), "kind": "log", "chunk": "500"})
    packs = source.partitions()
    assert len(source.tail.ranges({}, source.tail.ends())) > 1500 and tail.PARTS // 2 < len(packs) <= tail.PARTS
    got = [row for p in packs for row in source.read(p)]
    assert [g[2] for g in got] == [r for rs in records for r in rs]
    large = [tail.Range("f", i << 20, (i + 1) << 20, 4 << 30) for i in range(4096)]
    assert {len(p.ranges) for p in tail.packed(large)} == {32} and [r for p in tail.packed(large) for r in p.ranges] == large
    assert tail.packed([]) == [] and list(source.read(tail.Pack([]))) == []


def test_whole_ends():
    def end(data: bytes, kind: str) -> int:
        return tail._whole_end(lambda start, size: data[start : start + size], len(data), kind)

    one, two = record(1, "a").encode(), record(2, "b").encode()
    assert end(one, "log") == len(one) and end(one + two[:-3], "log") == len(one) and end(one[:-1], "log") == 0 and end(b"", "log") == 0
    assert end(one + b"2025-01-02 03:04:05,678 - INFO - plain\n", "log") == len(one) + 39
    assert end(b"data: {}\n\ndata: {", "frames") == 10 and end(b"data: {}\n", "frames") == 0
    long = b"data: " + b"x" * 300_000 + b"\n\n"
    assert end(long + b"data: half", "frames") == len(long)


@pytest.mark.parametrize("kind", ["log", "frames"])
def test_stream_over_growing_files(spark, tmp_path, kind):
    workers_import(spark)
    spark.dataSource.register(tail.RecordTail)
    logs = tmp_path / "logs"
    logs.mkdir()
    make = lambda i: record(i, f"m{i}") if kind == "log" else f'data: {{"m":{i}}}\n\n'
    whole = "".join(make(i) for i in range(30))
    cuts = [0, len(whole) // 3 + 5, 2 * len(whole) // 3 - 3, len(whole)]
    seen = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        with open(logs / "a.log", "a") as f:
            f.write(whole[a:b])
        stream = spark.readStream.format("record_tail").option("kind", kind).option("chunk", "200").load(f"file://{logs}")
        seen.append(sessions.run_available(stream, f"tail_{kind}", "append", str(tmp_path / "cp")).count())
    (logs / "b.log").write_text(make(30))
    stream = spark.readStream.format("record_tail").option("kind", kind).load(f"file://{logs}")
    rows = sessions.run_available(stream, f"tail_{kind}", "append", str(tmp_path / "cp")).collect()
    assert 0 < seen[0] < seen[1] < seen[2] == 30
    assert sorted(r.record for r in rows) == sorted(make(i) for i in range(31)) and len({(r.file, r.at) for r in rows}) == 31


def run_sink(df, path, checkpoint):
    query = df.repartition("session_id").writeStream.format("frame_sink").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(120)


def test_sink_commits_each_batch_once(spark, tmp_path):
    workers_import(spark)
    spark.dataSource.register(frame_sink.FrameSink)
    schema, path = "session_id string, ord long, frame string", str(tmp_path / "out")
    rows = [(f"s{i % 3}", 10 - i, f'data: {{"s":"s{i % 3}","o":{10 - i}}}\n\n') for i in range(10)]
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_sink(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, str(tmp_path / "cp"))
    got = frame_sink.read_frames(spark, path)
    assert sorted(r.record for r in got.collect()) == sorted(f for *_, f in rows)
    e = F.from_json(F.substring("record", 7, 1000), "s string, o long")
    for r in got.select("file", "at", e.alias("e")).groupBy("file", "e.s").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e.o"))), lambda x: x["o"]).alias("ords")).collect():
        assert list(r.ords) == sorted(r.ords)

    # the same batch again, as after a crash between its commit and the checkpoint's
    w = frame_sink.FrameWriter(path)
    again = [w.write(iter(spark.createDataFrame(rows, schema).collect())), w.write(iter(()))]
    w.commit(again, 0)
    assert frame_sink.read_frames(spark, path).count() == 10
    # a commit that broke off before its mark counts for nothing, and the next try replaces it
    half = tmp_path / "out" / "batch-000000000007"
    half.mkdir()
    (half / "part-000000.sse").write_text("data: half\n\n")
    assert frame_sink.read_frames(spark, path).count() == 10
    w.commit([w.write(iter(spark.createDataFrame(rows[:1], schema).collect()))], 7)
    assert frame_sink.read_frames(spark, path).count() == 11
    staged = w.write(iter(spark.createDataFrame(rows, schema).collect()))
    w.abort([staged, None], 8)
    assert not list((tmp_path / "out" / "_staged").iterdir())
