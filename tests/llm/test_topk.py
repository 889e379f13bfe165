from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from strandline.llm.topk_search import exact_topk, quantised

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, is_query, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q in good:
        if not is_query(q):
            continue
        scores = {c: max(sum(x * y for x, y in zip(a, b, strict=False)) for a in good[q] for b in vs) for c, vs in good.items() if c != q}
        for rank, (c, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((q, rank, c, max(-(1 << 63), min((1 << 63) - 1, s))))
    return sorted(out)


def search(spark, rows, is_query, k=5, **options):
    df = spark.createDataFrame([(i, v, "x", None) for i, v in rows], SCHEMA).repartition(3)
    vectors = df.select("vec_id", quantised(F.col("embedding")).alias("v"), "score", "rank")
    return sorted(tuple(r) for r in exact_topk(vectors, vectors.filter(is_query), k, **options).collect())


def test_against_brute_force(spark):
    import numpy as np

    rnd = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(0, 0.2, 8)]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]  # ties
    rows += [(460, None), (461, [1.0, None]), (462, [float("nan")] * 8), (463, [float("inf")] * 8), (None, [0.5] * 8), (464, []), (465, [0.25])]
    rows += [rows[0], rows[10], (7, [0.9] * 8)]  # repeated rows, and another vector of an id
    got = search(spark, rows, "vec_id % 10 = 0 or vec_id is null", pivots=6, sample=50, block=16)
    assert got == brute(rows, lambda i: i % 10 == 0, 5)


def test_few_candidates_and_empty(spark):
    rows = [(1, [0.1, 0.2]), (50, [0.3, -0.2]), (100, [0.1, 0.1])]
    assert search(spark, rows, "vec_id % 50 = 0") == brute(rows, lambda i: i % 50 == 0, 5)
    assert search(spark, rows[:1], "true") == []
    assert search(spark, [], "true") == []
    assert search(spark, [(1, None)], "true") == []


def test_floor_is_of_doubles(spark):
    df = spark.createDataFrame([(1, [-0.001, 0.00390625, 0.9999999])], "vec_id long, embedding array<float>")
    assert df.select(quantised(F.col("embedding"))).first()[0] == [-1, 1, 255]


def test_random_integers_many_blocks(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.randint(-3, 3) / 256 for _ in range(3)]) for i in range(150)]
    assert search(spark, rows, "true", k=3, pivots=4, sample=20, block=32) == brute(rows, lambda i: True, 3)


def test_intermediate_rows_do_not_grow_with_the_candidates(spark, monkeypatch):
    """A task hands on k rows of a query at most, over however many steps it takes its candidates."""
    import numpy as np

    from strandline.llm import topk_search

    paths, make = [], topk_search.scratch_path

    def noted(session, name):
        paths.append(make(session, name))
        return paths[-1]

    monkeypatch.setattr(topk_search, "scratch_path", noted)
    rnd = np.random.default_rng(3)
    for n in (1000, 6000):
        rows = [(i, [float(np.float32(x)) for x in rnd.normal(0, 0.2, 6)]) for i in range(n)]
        got = search(spark, rows, "vec_id < 40", k=3, pivots=4, sample=30, block=16, step_bytes=20_000)
        want = np.floor(256 * np.array([v for _, v in rows])).astype("i8")
        scores = want[:40] @ want.T
        for q in range(40):
            best = sorted((-int(scores[q, c]), c) for c in range(n) if c != q)[:3]
            assert [(r[2], r[3]) for r in got if r[0] == q] == [(c, -s) for s, c in best]
        found = spark.read.parquet(paths[-1])
        tasks = len([f for f in found.inputFiles()])
        assert tasks <= 4 and found.count() <= tasks * 40 * 3  # of four ranges, in one pass over all blocks


def test_large_components(spark):
    import numpy as np

    rnd = np.random.default_rng(8)
    for size in (5e3, 1e7, 1e12, 3e15):
        rows = [(i, [float(np.float32(x)) for x in rnd.normal(0, size, 6)]) for i in range(120)]
        rows += [(200 + i, rows[i][1][:5] + [float(np.float32(rows[i][1][5] * (1 + 1e-6)))]) for i in range(40)] + [(300, [5000.0] * 6), (301, [0.004] * 6)]
        assert search(spark, rows, "vec_id % 10 = 0", pivots=5, sample=40, block=8, pass_bytes=3000) == brute(rows, lambda i: i % 10 == 0, 5)


def test_exact_scores():
    import numpy as np

    from strandline.llm.topk_search import exact_scores

    rnd = random.Random(1)
    for bits in (10, 26, 40, 63):
        a, b = ([[rnd.randint(-(1 << bits), (1 << bits) - 1) for _ in range(300)] for _ in range(4)] for _ in range(2))
        got = exact_scores(np.array(a, "i8"), np.array(b, "i8"))
        assert [[int(x) for x in row] for row in got] == [[sum(x * y for x, y in zip(p, q, strict=True)) for q in b] for p in a]
