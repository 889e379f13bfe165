from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandline.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[str, int, int, str]]:
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end(), m[0]))
    return out


WORD = re.compile(r"[^\W_]+")


def least_share(hits: int, of: int, z: float) -> float:
    """The root of the quadratic whose solutions are the ends of the interval, the smaller one."""
    a, b, c = of + z * z, -(2 * hits + z * z), hits * hits / of
    return (-b - math.sqrt(max(b * b - 4 * a * c, 0))) / (2 * a)


def plain_terms(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """The method, occurrence by occurrence, in plain Python: (start, end, sign) of the terms of each text."""
    o = pii.Disclosure()
    placed, n_t, d_t, beside = [], Counter(), Counter(), defaultdict(set)
    for i, text in enumerate(texts):
        base = plain_spans(text)
        inside = {p for _, start, end, _ in base for p in range(start, end)}
        masked = "".join(" " if p in inside else c for p, c in enumerate(text))
        words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(masked) if len(m[0].lower()) >= pii.LEAST_LETTERS]
        placed.append(words)
        n_t.update(w.lower() for *_, w in words)
        d_t.update({w.lower() for *_, w in words})
        for kind, start, end, value in base:
            for s, e, w in words:
                if s >= start - pii.WINDOW and e <= end + pii.WINDOW:
                    beside[w.lower(), kind, value.lower()].add((i, s))
    best = {}
    for (term, *_), where in beside.items():
        best[term] = max(best.get(term, (0, 0)), (len({i for i, _ in where}), len(where)))
    share = {t: min(least_share(n, n_t[t], o.z), least_share(d, d_t[t], o.z)) for t, (d, n) in best.items()}

    def wide(beginning):  # the terms of a beginning as if they were one
        of = sum(n for t, n in n_t.items() if t.startswith(beginning))
        near = Counter()
        for (t, *c), where in beside.items():
            near[tuple(c)] += len(where) * t.startswith(beginning)
        return least_share(max(near.values()), of, o.z)

    marks = {}

    def sign(w):
        t = w.lower()
        if t not in marks:
            fine = [t[:n] for n in (6, 4, 2) if n < len(t) and wide(t[:n]) < 2**-o.generalise_bits - 1e-12]
            marks[t] = "" if share[t] >= 2**-o.remove_bits - 1e-12 else f"<{fine[0]}*>" if fine else None
        form = "number" if w.isdecimal() else "code" if any(c.isdecimal() for c in w) else "name" if w[0].isupper() else "word"
        return pii.FORMS[form] if marks[t] is None else marks[t]

    return [[(s, e, sign(w)) for s, e, w in words if share.get(w.lower(), 0) >= 2**-o.generalise_bits - 1e-12] for words in placed]


def named(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(got) == len(texts)
    terms = plain_terms(texts)
    for i, text in enumerate(texts):
        base = plain_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(named(base).encode()).hexdigest(), (text, got[i], base)
        counts = Counter(k for k, *_ in base)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(counts[k] for k in PLAIN)
        assert got[i].spans == named(base + [("term", s, e) for s, e, _ in terms[i]]), text
    return terms


def test_patterns_on_random_texts(spark):
    rnd = random.Random(11)
    alphabet = "ab1230.@+-() \n%_é4 5"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(600)]
    texts += ["a@b@c.d e@f.g_h@i.j..k@l.m", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.004", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (234) 567-8901 +1234 +12 3", "x" * 5000 + "@y.z", "1" * 5000, "+" * 300 + "1" + "(" * 3000]
    texts += ["a.b@c.de " * 700, ""]
    check(spark, texts)


def test_terms_that_disclose(spark):
    """A frequent neighbour of an address is disclosed, a lone word beside one is not."""
    rnd = random.Random(3)
    common = ["the", "meeting", "notes", "from", "today", "about", "plans"]
    texts = [f"{rnd.choice(common)} {rnd.choice(common)}\nJane Quillmark wrote:\njane.q@site.org {rnd.choice(common)} {i}\nother line" for i in range(12)]
    texts += [" ".join(rnd.choice(common) for _ in range(12)) + ("\nQuillmark pens" if i % 100 == 0 else "") for i in range(300)]
    texts += ["call +1 (234) 567-8901 now " + "long " * 60, " " * 200 + "word" * 60 + " a@b.cd", "Once3 Single beside 10.0.0.1"]
    texts += ["Zora Feld calls x@y.zz"] * 3 + ["Feldweg street"] * 9 + ["Kai 0815x x7@y.zz"] * 2
    terms = check(spark, texts)
    assert any(g == "" for t in terms for *_, g in t) and any(g for t in terms for *_, g in t)
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    for i, text in enumerate(texts):
        spans = sorted([(s, e, pii.PLACEHOLDERS[k]) for k, s, e, _ in plain_spans(text)] + terms[i])
        assert clean[i].text == "".join([text[a:b] + g for a, b, g in zip([0, *(e for _, e, _ in spans)], [s for s, *_ in spans] + [len(text)], [g for *_, g in spans] + [""], strict=True)])
    assert "@" not in clean[0].text and "Jane" not in clean[0].text and "<EMAIL>" in clean[0].text and "Quillmark" not in clean[0].text
    assert "Quillmark" not in clean[12].text and clean[12].text.endswith(" pens")  # wherever the term stands
    assert clean[13].text == texts[13] and clean[13].base == "n"
    assert clean[314].text == "Once3 Single beside <IP>"  # words that stand once
    assert clean[315].text == "<NAME> <fe*> <call*> <EMAIL>" and clean[318].text == texts[318]  # a beginning is shorter than the term


def test_occurrences_in_one_document_tell_nothing(spark):
    texts = ["Nora a@b.cd met a@b.cd and wrote a@b.cd Nora Nora Nora", "they met and wrote", "they met", "they wrote", "and so on"]
    assert not any(check(spark, texts))
    again = [*texts, "Nora a@b.cd", "Nora, a@b.cd"]
    terms = check(spark, again)
    assert {again[5][s:e] for s, e, _ in terms[5]} == {"Nora"} and len(terms[0]) == 4


def test_generalised_to_a_beginning(spark):
    texts = ["Feldner x@y.zz"] * 3 + ["Feldweg", "Feldbach", "Felder", "Feldweg here", "feldspar", "Feld", "fe"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert check(spark, texts)[0] == [(0, 7, "<feld*>")]
    assert {r.text for r in pii.sanitise(docs).collect()} == {"<feld*> <EMAIL>", *texts[3:]}


def test_many_entities(spark):
    texts = [" ".join(f"w{i} u{i % 50}@site.org é" for i in range(3000)), "+1 (234) 567-8901 x@y.zz " * 1500]
    check(spark, texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not any("@" in r.text for r in pii.sanitise(docs).collect())


def test_sanitise_against_plain(spark):
    texts = ["a@b.cd +1 (234) 567-8901, 4111111111111111 and 1.2.3.4", "+4111 1111 1111 1111", "and none and", "", "é a@b.cd é"]
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert got[None] is None
    for i, text in enumerate(texts):
        out, at = "", 0
        for kind, start, end, _ in sorted(plain_spans(text), key=lambda s: (s[1], s[2])):
            if start >= at:
                out += text[at:start] + pii.PLACEHOLDERS[kind]
            at = max(at, end)
        assert got[i] == out + text[at:]


def test_length_follows_changed_texts_only(spark):
    docs = spark.createDataFrame([(1, "a@b.cd!", 99), (2, "clean", 99), (3, None, None)], "doc_id long, text string, n_chars long")
    assert {r.doc_id: r.n_chars for r in pii.sanitise(docs, length_col="n_chars").collect()} == {1: len("<EMAIL>!"), 2: 99, 3: None}


def test_edges(spark):
    schema = "doc_id long, text string, h1 string, base string"
    rows = [(None, None, "x", "y"), (1, "a@b.cd", None, None), (1, "a@b.cd", None, None), (2, "", "x", "y")]
    got = pii.find_pii(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_email) for r in got) == [(False, 1, 1), (False, 1, 1), (False, 2, 0), (True, 0, 0)]
    none = spark.createDataFrame([], schema)
    assert pii.find_pii(none).count() == 0 and pii.sanitise(none).count() == 0
    assert pii.sanitise(spark.createDataFrame(rows, schema)).filter(F.col("text") == "<EMAIL>").count() == 2
