from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from strandline.llm import spelling as sp


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, least=7, least_n=2, times=10, slip=31):
    """Pair by pair, in plain Python."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % slip else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= least_n}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: [v for v in words if v != w and near(w, v)] for w in words}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(links[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    out = sp.spelling_groups(df, **options)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_against_pairs(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    weights = [rnd.choice([1, 1, 2, 40, 600]) for _ in words]
    texts = [" ".join(rnd.choices(words, weights, k=200)) for _ in range(60)] + ["ABABABA ababaBa", "aaaaaaaa", "aaaaaaa aaaaaaaa"]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, None), (5, ""), (6, "12 !? " + "É" * 8 + "é" * 8)]
    got = run(spark, rows)
    assert got == plain(rows)
    assert any(r[1] for r in got) and any(r[4] and not r[1] for r in got)  # forms, and near words that are none
    assert run(spark, rows, slip=3, times=2, least_letters=8) == plain(rows, 8, 2, 2, 3)


def test_chain_of_three_forms(spark):
    texts = ["aaaaaaa " * 2 + "aaaaaab " * 30 + "aaaaabb " * 400 + "aaaabbb " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r[0]: r for r in run(spark, rows, slip=1 << 40)}
    assert got["aaaaaaa"][1:3] == ("aaaaaab", "aaaabbb") and got["aaaaaab"][1:3] == ("aaaaabb", "aaaabbb") and got["aaaabbb"][1:3] == (None, "aaaabbb")


def test_ties_go_to_the_first_word(spark):
    rows = [(1, "aaaaaab " * 2 + "aaaaaac " * 20 + "aaaaaad " * 20 + "aaaaaabz " * 20)]
    got = {r[0]: r for r in run(spark, rows, slip=1 << 40)}
    assert got["aaaaaab"] == ("aaaaaab", "aaaaaabz", "aaaaaabz", 2, 3, 20)


def test_long_words(spark):
    rnd = random.Random(1)
    base = "".join(rnd.choice("abcxyz") for _ in range(63))
    words = [base, base + "q", base + "qq", base + "qr", base[:30] + "é" + base[30:] + "qr", "z" * 66, "z" * 67, "y" + "z" * 65, "w" * 5000, "w" * 4999, "w" * 2500 + "v" + "w" * 2499]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(zip(words, [2, 30, 2, 30, 2, 2, 20, 2, 2, 20, 2], strict=True))]
    assert run(spark, rows, slip=1 << 40) == plain(rows, slip=1 << 40)


def test_long_keys_tell_letters_apart():
    word = "ab" * 32 + "bb"
    keys = list(sp.long_keys(word))
    assert len(keys) == len(set(keys)) and sum(k == "wild" for k, _ in keys) == 66
    assert sum(k == "less" for k, _ in keys) == len({word[:i] + word[i + 1 :] for i in range(66)})
    other = dict.fromkeys(k for k in sp.long_keys("ab" * 32 + "cb") if k[0] == "wild")
    assert len([k for k in keys if k in other]) == 1  # the words differ in one letter
    shorter = {k[1] for k in sp.long_keys("ab" * 32 + "b") if k[0] == "word"}
    assert shorter <= {k for kind, k in keys if kind == "less"}


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (None, "short words of no use")]) == []
