from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import toxicity as tox
from strandline.llm.queries import op5_toxicity
from strandline.llm.textvec import words_of

NEUTRAL = "tree river house walk paper stone window garden bread music table cloud summer winter street".split()


def corpus(seed, n):
    """Insults make a text toxic; 'muslims' stands mostly in toxic texts without making them so."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = rnd.random() < 0.35
        words = [rnd.choice(NEUTRAL) for _ in range(rnd.randint(5, 15))]
        if rnd.random() < (0.9 if toxic else 0.05):
            words.insert(rnd.randrange(len(words)), "muslims")
        if toxic and rnd.random() < 0.6:
            words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "scum", "idiots"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def models(spark):
    rows = corpus(1, 1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    plain = tox.train(docs, labels, swap_penalty=0.0)
    fair = tox.train(docs, labels, swap_penalty=10.0)
    return plain, fair


def scores(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.score for r in tox.score(df, model).collect()}


def test_swaps_change_scores_less(spark, models):
    plain, fair = models
    assert fair.gap < 0.2 * plain.gap
    mention = ["muslims walk in the garden", "christians walk in the garden", "walk in the garden"]
    a, b = scores(spark, plain, mention), scores(spark, fair, mention)
    assert a[0] > 0.5 > b[0]  # the false positive on a neutral mention goes
    assert abs(b[0] - b[1]) < 0.2 * abs(a[0] - a[1])
    assert scores(spark, fair, ["you vile scum"])[0] > 0.5


def test_held_out_accuracy(spark, models):
    rows = corpus(2, 400)
    got = scores(spark, models[1], [t for _, t, _ in rows])
    named = [(got[i] >= 0.5) == bool(y) for i, t, y in rows if y == 0 or any(w in t.split() for w in ("vile", "scum", "idiots"))]
    assert sum(named) / len(named) > 0.95


def plain_model(rows, options):
    """Word and beginnings, chi-square, and the loss with every swap written out text by text, minimised in plain numpy."""
    families = options["families"]

    def found(text):
        out = set()
        for w in words_of(text):
            raw = w.encode()
            out |= {raw} | {("stem", raw[:size]) for size in tox.STEMS if len(raw) > size}
        return out

    sets = [found(t) for _, t, _ in rows]
    y = np.array([float(x > 0) for *_, x in rows])
    copies = Counter(map(frozenset, sets))
    share = np.array([1 / copies[frozenset(x)] for x in sets])
    n, ones = share.sum(), (share * y).sum()
    has, a = defaultdict(float), defaultdict(float)
    for x, s, one in zip(sets, share, y, strict=True):
        for f in x:
            has[f] += s
            a[f] += s * one
    chi = {f: n * (a[f] * (n - ones) - (has[f] - a[f]) * ones) ** 2 / (has[f] * (n - has[f]) * ones * (n - ones)) for f in has if options["least_docs"] - 1e-6 <= has[f] < n - 1e-6}
    names = [f for f in chi if chi[f] >= options["least_chi_square"]]
    assert len(names) <= 512
    names = sorted({*names, *(t.encode() for family in families for t in family)}, key=repr)
    number = {f: i for i, f in enumerate(names)}

    def vector(x):
        v = np.zeros(len(names) + 1)
        v[[number[f] for f in x if f in number]] = 1
        v[-1] = 1
        return v

    data = np.array([vector(x) for x in sets])
    penalty = np.diag([options["l2"]] * len(names) + [1e-6])
    for x, s in zip(sets, share, strict=True):
        for family in families:
            for t in family:
                if t.encode() in x:
                    for other in [*family, None]:
                        if other != t:
                            gap = vector(found(t)) - (vector(found(other)) if other else vector(set()))
                            penalty += options["swap_penalty"] * s / len(family) * np.outer(gap, gap)
    w = np.zeros(len(names) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-data @ w))
        w -= np.linalg.solve(data.T @ (data * (share * p * (1 - p))[:, None]) + penalty, data.T @ (share * (p - y)) + penalty @ w)
    return lambda text: 1 / (1 + np.exp(-vector(found(text)) @ w))


def test_scores_equal_plain_refit(spark):
    rows = corpus(3, 400)
    rows += [(1000 + i, rows[5][1], i % 2) for i in range(40)]  # copies with both labels
    families = (("muslims", "christians", "jews"), ("women", "men"))
    options = {"least_docs": 3, "least_chi_square": 5.0, "l2": 0.5, "swap_penalty": 2.0, "families": families}
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = tox.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), **options)
    plain = plain_model(rows, options)
    texts = [t for _, t, _ in rows[:80]] + ["", "nothing known", "men and women", "christians walk"]
    got = scores(spark, model, texts)
    assert max(abs(got[i] - plain(t)) for i, t in enumerate(texts)) < 2e-3


def test_texts_that_share_a_passage(spark):
    rnd = random.Random(4)
    passage = " ".join(rnd.choice(NEUTRAL) + str(i) for i in range(300))
    rows = [(i, f"{passage} {rnd.choice(NEUTRAL)} {'vile' if i % 2 else 'kind'} {rnd.choice(NEUTRAL)}{i}", i % 2) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = tox.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    got = scores(spark, model, [passage + " vile", passage + " kind"])
    assert got[0] > 0.9 and got[1] < 0.1


def test_query_on_documents(spark, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.1")
    got = op5_toxicity(spark, base)
    labels = spark.read.parquet(f"{base}/labels.parquet").filter("toxic is not null")
    rows = got.join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in rows) / len(rows)
    caught = [r.predicted for r in rows if r.toxic]
    assert right > 0.97 and sum(caught) / len(caught) > 0.85
    assert got.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).count() == 0


def test_edges(spark, models):
    schema = "doc_id long, text string, score string, label int"
    rows = [(None, None, "x", 1), (1, "", "x", 1), (1, "", "x", 1), (2, "vile " * 60_000, None, None), (3, "scum", "x", 2)]
    df = spark.createDataFrame(rows, schema)
    got = tox.score(df, models[1]).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    clean = tox.keep_clean(df, models[1])
    assert clean.columns == df.columns and sorted((r.doc_id or 0) for r in clean.collect()) == [0, 1, 1]
    assert tox.score(df.limit(0), models[1]).count() == 0 and tox.keep_clean(df.limit(0), models[1]).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.train(df, none) is None
    assert tox.train(df, spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")) is None
    assert {r.score for r in tox.score(df, None).collect()} == {0.0} and tox.keep_clean(df, None).count() == 5
