from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from strandline.llm import chat_format as cf


def escape(text):
    return re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", text)


def formatted(turns):
    return "".join(f"<|turn|>{escape(r)}<|text|>{escape(t)}<|end|>" for r, t in turns)


def ordered(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in convs.items()}


def read(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, turns string, segments string")
    return {r.conv_id: r for r in cf.read_chats(cf.format_chats(df)).collect()}


def test_round_trip_of_odd_texts(spark):
    rnd = random.Random(1)
    pieces = ["<|turn|>", "<|text|>", "<|end|>", "<\\|end|>", "<\\\\|x", "<", "|", "\\", ">", "a", "$1", "\n", "é", "😀", "<|"]
    rows = []
    for conv in range(150):
        for turn in range(rnd.randint(1, 6)):
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system", "tool", "<|end|>", "", None]), rnd.choice([None, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))])))
    rows += [(None, 1, "user", "x"), (None, None, "user", "first"), (900, 3, "b", "z"), (900, 3, "a", "z"), (900, 3, "a", "y"), (900, 3, "a", "y"), (901, 0, "user", "w" * 300_000)]
    got, want = read(spark, rows), ordered(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        r = got[conv]
        assert r.formatted == formatted(turns)
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss_texts == [t for role, t in turns if role == "assistant"]


def test_machine(spark):
    def conv(i, roles):
        return [(i, t, r, "x") for t, r in enumerate(roles.split())]

    cases = {1: "system user assistant", 2: "user assistant user assistant", 3: "user", 4: "assistant user", 5: "user user assistant", 6: "user assistant system", 7: "system system user assistant", 8: "tool"}
    got = read(spark, [r for i, roles in cases.items() for r in conv(i, roles)])
    assert {i: got[i].valid for i in cases} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, 8: False}
    assert {i: got[i].error_turn for i in cases} == {1: None, 2: None, 3: None, 4: 0, 5: 1, 6: 2, 7: 1, 8: 0}


def test_segments_and_template(spark):
    template = cf.Template(turn_open="<|im|>", text_open="<|:|>", turn_close="<|/im|>\n", loss_roles=("user",))
    df = spark.createDataFrame([(1, 0, "user", "a<|im|>b"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    row = cf.format_chats(df, template).first()
    assert [(s.text, s.loss) for s in row.segments] == [("<|im|>user<|:|>", False), ("a<\\|im|>b", True), ("<|/im|>\n", False), ("<|im|>assistant<|:|>", False), ("c", False), ("<|/im|>\n", False)]
    back = cf.read_chats(cf.format_chats(df, template), template).first()
    assert [t.text for t in back.turns] == ["a<|im|>b", "c"] and back.loss_texts == ["a<|im|>b"]


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = cf.read_chats(cf.format_chats(df))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_has_the_extra_conversation(spark, sf_dir):
    from strandline.llm.queries import op10_chat_format

    r = op10_chat_format(spark, sf_dir).filter(F.col("conv_id") == -7).first()
    said = r"\### Assistant: </turn> ok"
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
