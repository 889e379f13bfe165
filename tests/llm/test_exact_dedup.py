from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import exact_dedup as xd


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep, left = (max(named) if named else None), True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and left
            left = left and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, key string, size long, keep_id string")
    return sorted((tuple(r) for r in xd.exact_dedup(df, **options).collect()), key=repr)


TEXTS = ["", None, "A", "a", "É", "é", "ABC def", "abc DEF", "abc def ", "ß", "SS", "x" * 200_000, "X" * 200_000, "İ", "i̇", "K", "k"]


@pytest.mark.parametrize("options", [{}, {"key_bits": 2}, {"key_bits": 3, "capacity": 1}, {"capacity": 1}, {"capacity": 5}])
def test_against_brute_force(spark, options):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(TEXTS + ["hot"] * 12 + [str(i)])) for i in range(300)]
    rows += [(None, "A"), (None, "lone"), (None, "lone"), (5, rows[5][1]), (5, rows[5][1]), (7, "other text of id 7")]
    assert run(spark, rows, **options) == brute(rows)


def test_chains_hold_the_texts_of_a_key(spark):
    """With one bit all texts lie under two keys: each is a link of its chain, in order, with its copies counted by its owner."""
    rows = [(i, t) for i, t in enumerate(TEXTS + ["hot"] * 50) if t is not None]
    df = spark.createDataFrame(rows, "id long, text string").select("id", xd.normalised(F.col("text")).alias("norm"))
    df = df.withColumn("key", F.shiftleft(F.shiftrightunsigned(F.xxhash64("norm"), 63), 63))
    _, _, entries = xd.build_index(df, df)
    want = defaultdict(dict)
    for r in df.collect():
        want[r.key].setdefault(r.norm, []).append(r.id)
    assert len(want) == 2
    for key, texts in want.items():
        got = entries.filter(F.col("key") == key).orderBy("link").collect()
        assert [(r.link, r.sha, r.size, r.keep) for r in got] == [(i + 1, hashlib.sha256(t.encode()).hexdigest(), len(texts[t]), max(texts[t])) for i, t in enumerate(sorted(texts, key=lambda t: t.encode()))]


def test_lookups_go_through_the_directory(spark, monkeypatch):
    """Without one of its slots, just the rows of that slot's keys are not found."""
    rows = [(i, str(i % 90)) for i in range(200)]
    whole, build = run(spark, rows, capacity=4), xd.build_directory
    gone = []

    def torn(keys, capacity):
        directory, depth = build(keys, capacity)
        gone.append((directory.agg(F.min("slot")).first()[0], depth))
        return directory.filter(F.col("slot") != gone[0][0]), depth

    monkeypatch.setattr(xd, "build_directory", torn)
    left = run(spark, rows, capacity=4)
    slot, depth = gone[0]
    keys = {r.t: r.k for r in spark.createDataFrame([(str(i),) for i in range(90)], "t string").select("t", F.xxhash64("t").alias("k")).collect()}
    lost = {hashlib.sha256(t.encode()).hexdigest() for t, k in keys.items() if (k % (1 << 64)) >> (64 - depth) == slot}
    assert lost and left == [r for r in whole if r[4] not in lost]


def test_empty(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert xd.drop_copies(df).count() == 0


def plain_directory(keys: list[int], capacity: int) -> dict[int, tuple[int, int]]:
    """(first key, local depth) of each key's bucket, split by split."""
    out, todo = {}, [(sorted(keys), 0)]
    while todo:
        own, depth = todo.pop()
        if len(own) > capacity and depth < 64:
            bit = 63 - depth
            todo += [([k for k in own if k >> bit & 1 == side], depth + 1) for side in (0, 1)]
        else:
            out |= {k: (k >> (64 - depth) << (64 - depth), depth) for k in own}
    return out


@pytest.mark.parametrize("capacity", [1, 2, 4, 100])
def test_directory_doubling(spark, capacity):
    rnd = random.Random(2)
    keys = sorted({rnd.getrandbits(64) for _ in range(40)} | {0, 1, 2, 3, (1 << 64) - 1, 0b1011 << 60, (0b1011 << 60) + 1})
    df = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "key long")
    directory, depth = xd.build_directory(df, capacity)
    want = plain_directory(keys, capacity)
    assert depth == max(d for _, d in want.values())
    got = {(r.slot % (1 << 64), r.bucket % (1 << 64), r.depth) for r in directory.collect()}
    up = 64 - depth
    assert got == {(k >> up, first >> up, d) for k, (first, d) in want.items()}
    assert len(xd._located(df, directory, depth).collect()) == len(keys)


def test_empty_directory(spark):
    directory, depth = xd.build_directory(spark.createDataFrame([], "key long"), 4)
    assert depth == 0 and directory.count() == 0


def test_stage_keeps_rows_and_columns(spark):
    rows = [(1, "Aa", "p"), (2, "aa", "q"), (3, "b", "r"), (3, "b", "r"), (4, None, "s"), (None, "", "t"), (5, "b", "u"), (6, "c", "own_sha")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_sha string")
    out = xd.drop_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.own_sha) for r in out.collect()) == [(2, "q"), (4, "s"), (5, "u"), (6, "own_sha")]
    again = spark.createDataFrame([(3, "b", "r"), (3, "b", "r"), (3, "B", "z")], df.schema)
    assert xd.drop_copies(again).count() == 1


def test_native_plan(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    plan = xd.exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
