from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality_rules as qr


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab \n\t\r\x0b\x0c\x1c\x85  é#*<") for _ in range(rnd.randint(0, 120))) for _ in range(500)]
    texts += [None, "", "a a a", "a a a a", "x y z x y z", "a b c d a b c", "one\none\r\none\n\n \n \n", "word " * 3000, "é" * 100_000, "\n" * 50]
    for t in texts:
        assert qr.text_counts(t) == plain_counts(t), t


def test_limits():
    assert qr.base_failed(49, 0) and not qr.base_failed(50, 25) and qr.base_failed(50, 26) and qr.base_failed(0, 0)


def test_features_do_not_depend_on_neighbours():
    rnd = random.Random(2)
    texts = ["", "a", "ab cd", " ", "\U0001f600 é\n", "word"] + [" ".join(rnd.choice(["the", "é", "x1", "Q##"]) for _ in range(30)) for _ in range(10)]
    with np.errstate(over="ignore"):
        bounds, places, values = qr.features(texts)
        for i, t in enumerate(texts):
            _, p, v = qr.features([t])
            own = slice(bounds[i], bounds[i + 1])
            assert (places[own] == p).all() and np.allclose(values[own], v) and (not len(p) or abs(float(v.astype("f8") @ v) - 1) < 1e-5)
    assert len(qr.features([""])[1]) == 0
    assert np.allclose(qr.logits(texts, np.linspace(-1, 1, qr.BUCKETS), 0.5), [qr.logits([t], np.linspace(-1, 1, qr.BUCKETS), 0.5)[0] for t in texts])


def test_fit_finds_the_minimum():
    rnd = np.random.default_rng(0)
    rows = [np.sort(rnd.choice(40, 6, replace=False)) for _ in range(120)]
    places, values = np.concatenate(rows).astype("u2"), np.full(720, 6**-0.5, "f4")
    y = np.array([float(3 in r) if i % 9 else 1.0 - (3 in r) for i, r in enumerate(rows)])
    w, bias = qr.fit(np.arange(0, 721, 6), places, values, y, 0.1, rounds=300)
    x = np.zeros((120, qr.BUCKETS))
    for i, r in enumerate(rows):
        x[i, r] = 6**-0.5
    r = 1 / (1 + np.exp(-(x @ w + bias))) - y
    assert np.abs(x.T @ r + 0.1 * w).max() < 0.02 and abs(r.sum()) < 0.02 and w[3] == w.max()


def test_calibration():
    rnd = np.random.default_rng(1)
    z = rnd.normal(size=4000) * 4
    y = (rnd.random(4000) < 1 / (1 + np.exp(-(0.5 * z + 1)))).astype("f8")
    slope, offset = qr.calibrate(z, y)
    assert abs(slope - 0.5) < 0.06 and abs(offset - 1) < 0.15
    assert all(np.isfinite(qr.calibrate(np.array([5.0, -5.0] * 20), np.array([1.0, 0.0] * 20))))


def rows_of(n=300):
    rnd = random.Random(7)
    words = ["river", "mountain", "house", "wrote", "étude", "letter", "green", "walks"]

    def good():
        return " ".join(rnd.choice(words) + rnd.choice(["", "s", "ed", "."]) for _ in range(80))

    junk = [lambda: " ".join(w + rnd.choice(["###", "$$$"]) for w in good().split()), lambda: " ".join(w.upper() + "!!" for w in good().split())]
    out = []
    for i in range(n):
        bad = i % 4 == 0
        out.append((i, rnd.choice(junk)() if bad else good(), int(not bad)))
    return out


def test_held_out_rows(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5, "another text of id 5"), (None, "x"), (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 5] + [(6, 1), (None, 0), (7, None), (4444, 1)], "doc_id long, quality int")
    model = qr.train(docs, labels)
    got = {r.doc_id: r for r in qr.judge(docs.filter("doc_id <> 5 OR length(text) > 50"), model).collect()}
    assert all(got[i].kept == bool(q) for i, _, q in rows if i % 5 == 0)
    assert all(abs(got[i].quality - q) < 0.4 for i, _, q in rows if i % 5 == 0)
    assert not got[900].kept and got[900].base_failed and got[900].n_words == 0
    again = qr.train(docs.repartition(7), labels.repartition(3))
    assert np.allclose(model.weights, again.weights) and abs(model.slope - again.slope) < 1e-9
    kept = {r.doc_id for r in qr.keep_good(docs.filter("doc_id < 300 AND length(text) > 50").withColumn("kept", F.lit("c")), model).collect()}
    assert kept == {i for i, r in got.items() if i is not None and i < 300 and r.kept}


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(i, 1) for i in range(300)]])
def test_without_both_labels(spark, labels):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows_of(40)], "doc_id long, text string")
    model = qr.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model is None
    got = qr.judge(docs, model).collect()
    assert all(r.kept and r.quality is None for r in got) and qr.keep_good(docs, None).count() == 40


def test_edges(spark):
    schema = "doc_id long, text string, kept string, quality string, id string"
    rows = [(None, None, "a", "b", "c"), (1, "", None, None, None), (1, "", None, None, None), (2, "w " * 60, "a", "b", "c")]
    got = qr.judge(spark.createDataFrame(rows, schema), None).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in got) == [(0, 0, True, False), (1, 0, True, False), (1, 0, True, False), (2, 60, True, False)]
    assert qr.judge(spark.createDataFrame([], schema), None).count() == 0
