from __future__ import annotations

import random

import numpy as np
import pytest

from strandline.llm import jaccard_join as jj
from strandline.llm.components import components
from strandline.llm.textvec import shingle_hashes, words_of


def shingles(text, k=5):
    w = words_of(text or "")
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if i != j and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(len(rows))]
    label = [-1] * len(rows)
    for i in range(len(rows)):
        todo = [i] if label[i] < 0 else []
        while todo:
            x = todo.pop()
            if label[x] < 0:
                label[x] = i
                todo += near[x]
    out = []
    for i, (doc, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if label[j] == label[i]]
        out.append((doc, min((x for x in own if x is not None), default=None), len(near[i]), len(own)))
    return sorted(out, key=repr)


def corpus(seed=1, n=160):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.35 or not rows:
            words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 150))]
        elif kind < 0.55:
            words = passage + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        else:
            words = rnd.choice(rows)[1].split()
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("options", [{}, {"block_rows": 3}, {"block_bytes": 2000}])
def test_against_brute_force(spark, options):
    rows = corpus()
    rows += [(1000, None), (1001, ""), (1002, " .,! "), (1003, "One Two"), (1004, "one, two."), (1005, "one two three"), (None, "one two"), (3, rows[3][1]), (3, rows[3][1]), (1006, "z " * 20_000), (1007, "Z " * 20_001)]
    df = spark.createDataFrame([(i, t, "x", b"n") for i, t in rows], "doc_id long, text string, node string, key binary")
    got = sorted((tuple(r) for r in jj.jaccard_join(df, **options).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("options", [{"block_rows": 3}, {"block_bytes": 2000}])
def test_text_and_its_doubling_in_a_large_group(spark, options):
    """A text written twice has nearly the same set of shingles at twice their number."""
    rnd = random.Random(8)
    words = [f"d{i}" for i in range(200)]
    rows = [(0, " ".join(words)), (1, " ".join(words + words)), (2, " ".join(words * 4))]
    for i in range(3, 12):
        other = list(words)
        other[rnd.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jj.jaccard_join(df, **options).collect()), key=repr) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, th string")
    assert jj.jaccard_join(df).count() == 0
    assert jj.keep_representatives(df).count() == 0


def test_representatives(spark):
    rows = corpus(2, 80) + [(500, None), (501, ""), (None, "alone here"), (None, "alone here")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, th string")
    out = jj.keep_representatives(df)
    assert out.columns == df.columns
    classes = {r[1] for r in brute(rows) if r[1] is not None}
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(classes)
    assert out.filter("doc_id is null").count() == 1


def test_recall_on_pairs_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.83 only: the forest has to meet its target."""
    rnd, rows, want = random.Random(6), [], 0
    for i in range(300):
        words = [f"t{rnd.randrange(10**6)}" for _ in range(120)]
        other = words[:108] + [f"u{rnd.randrange(10**6)}" for _ in range(12)]
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        want += len(a & b) / len(a | b) >= 0.8
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_links = 1").count() / 2
    assert want == 300 and got >= 0.99 * want


def test_prefix_is_shortened_to_the_recall():
    assert jj.prefix_length(16, 5, 0.8, 0.999) == 4 and jj.prefix_length(16, 5, 0.8, 0.9) == 5 and jj.prefix_length(1, 5, 0.8, 0.999) == 1
    assert 1 - (1 - 0.8**4) ** 16 >= 0.999


def test_nodes_stop_where_their_recall_is_reached():
    for n in range(1, 40):
        plain = min((n - lost) / (n + gained) for lost in range(n) for gained in range(n) if (n - lost) / (n + gained) >= 0.8 - 1e-12)
        assert jj.least_similarity(n, 0.8) == pytest.approx(plain)
    stops = jj.stop_lengths(16, 6, 0.8, 0.999)
    assert stops[1] == stops[3] == 6 and stops[-1] == 4 and min(stops[1:]) == 4
    for n in range(1, 200):
        assert stops[n] == 1 or 1 - (1 - jj.least_similarity(n, 0.8) ** stops[n]) ** 16 >= 0.999


@pytest.mark.parametrize("sides", [False, True])
@pytest.mark.parametrize("size", [5, 33, 150])
def test_a_trie_joins_what_all_pairs_join(size, sides):
    rnd = np.random.default_rng(size)
    for _ in range(6):
        base = rnd.integers(0, 3, (6, 24)).astype("u4")
        sigs = base[rnd.integers(0, 6, size)]
        sigs = np.where(rnd.random(sigs.shape) < 0.15, rnd.integers(0, 50, sigs.shape), sigs).astype("u4")
        labels, stop = sigs[:, :4], rnd.integers(1, 5, size)
        near = rnd.integers(0, 2, size) if sides else np.full(size, 2)
        left, right = [], []
        for i in range(size):
            for j in range(i):
                length = max(stop[i], stop[j])
                if (near[i] != near[j] or near[i] == 2) and (labels[i, :length] == labels[j, :length]).all() and (sigs[i] == sigs[j]).sum() >= 16:
                    left.append(i)
                    right.append(j)
        want, got = jj._star(np.array(left, int), np.array(right, int), size), jj._joined(labels, sigs, stop, near, 16, 1)
        assert {frozenset(np.flatnonzero(want == c)) for c in set(want)} == {frozenset(np.flatnonzero(got == c)) for c in set(got)}


def test_blocks_of_a_large_key_are_dealt_evenly(spark):
    df = spark.range(4000).selectExpr("CAST(1 AS LONG) AS key", "CAST(CAST(id AS STRING) AS BINARY) AS node", "100 AS n", "CAST(0 AS LONG) AS size")
    small, big = jj._tasks(df, "key", 0.8, 256, 1 << 30)
    assert small.count() == 0
    per_task = big.groupBy("task", "place").count().collect()
    assert len({r.task for r in per_task}) == len({r.place for r in per_task}) == len(per_task) == 16 * 17 // 2
    assert max(r.place for r in per_task) - min(r.place for r in per_task) == len(per_task) - 1


def test_shingle_hashes_equal_plain_sets():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab cé. \n0ÀZ") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["", "a", "one two three four five"]
    seen = {}
    h, at = shingle_hashes(texts)
    for i, t in enumerate(texts):
        plain, hashed = shingles(t), set(h[at[i] : at[i + 1]].tolist())
        assert len(plain) == len(hashed)
        w = words_of(t)
        for x, y in zip([tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else [], h[at[i] : at[i + 1]].tolist(), strict=True):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rnd = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 50)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
