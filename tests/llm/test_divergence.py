from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandline.llm import divergence as dv


def plain(rows, least=30, smoothing=5, top=50):
    """Group by group, in whole numbers."""
    occurs, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", low)
        groups[lang].add(source)
        occurs[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept) + smoothing * len(kept)
            return {t: 1 + 10**9 * (counts[t] + smoothing) // total for t in kept}

        whole = shares(sum((occurs[lang, s] for s in sources), Counter()))
        own = {s: shares(occurs[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, own[s][t] - whole[t]) for t in kept if occurs[lang, s][t] and own[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(a, b, c, 1, "x", 2) for a, b, c in rows], "lang string, source string, text string, n long, term string, counts long")
    out = dv.divergence(df.repartition(3), **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


def texts(n=400):
    rnd = random.Random(8)
    words = ["the", "The", "ÉTÉ", "été", "x-y", "a1b", "naïve", "日本", "z", "_", "end of", "tİ"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(n):
        lang = rnd.choice(["en", "en", "fr", None])
        source = rnd.choice(["hot"] * 5 + ["s1", "s2", "", None])
        own = words[: 12 + 5 * len(source or "")]
        rows.append((lang, source, None if i % 50 == 0 else " ".join(rnd.choices(own, k=rnd.randint(0, 30)))))
    return rows


def test_against_plain(spark):
    rows = texts()
    rows += [("en", "empty", ""), ("lone", "only", "word"), ("two", "a", "x"), ("two", "b", None)] + [("rep", "s", "same same")] * 40
    got = run(spark, rows)
    assert got == plain(rows)
    assert any(r[:2] == ("two", "a") and r[4] == 0 for r in got) and not any(r[0] == "lone" for r in got)
    assert run(spark, rows, least_docs=3, smoothing=1, top_terms=4) == plain(rows, 3, 1, 4)


def test_tasks_that_hand_on_early(spark, monkeypatch):
    rows = texts(120)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    counted = dv.count_terms(df).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()
    occurs, docs = Counter(), Counter()
    for lang, source, text in rows:
        found = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        occurs.update((lang or "", source or "", t) for t in found)
        docs.update((lang or "", source or "", t) for t in set(found))
    assert {(r.lang, r.source, r.term): (r.n, r.docs) for r in counted} == {k: (n, docs[k]) for k, n in occurs.items()}


def test_shares_of_any_size(spark):
    pairs = [(0, 1), (7, 1000), (8_999_999_999, 10**10), (9_000_000_001, 10**11), (10**17, 3 * 10**17 + 1)]
    df = spark.createDataFrame(pairs, "n long, total long")
    got = df.select("n", "total", dv._share(F.col("n"), F.col("total"), 5).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 5) // r.total for r in got)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, None, None)]) == []
