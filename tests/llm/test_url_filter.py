from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest

from strandline.llm import url_filter as uf


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    best = None
    for what, rule in uf.RULES:
        name, slash, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + tail) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return best or (None, None)


def segments(path):
    def general(s):
        m = re.fullmatch(r"(.*?)(\.[A-Za-z]{1,5})?", s, re.S)
        stem, end = m[1], m[2] or ""
        if re.fullmatch("[0-9]+", stem):
            return "{n}" + end
        if re.fullmatch("[0-9a-fA-F]{8,}", stem) or re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", stem):
            return "{hex}" + end
        return "{x}" + end if re.search("[0-9]", stem) else s

    return tuple(general(s) for s in path.split("/") if s)


def brute(rows, o):
    """template and share of (host, segments, label or None) rows: the tree walked node by node in plain Python."""
    hosts = defaultdict(list)
    for host, segs, label in rows:
        hosts[host].append((segs, label))
    blocked = sum(label == "block" for *_, label in rows)
    root = (blocked + 1.0) / (sum(label is not None for *_, label in rows) + 2.0)
    out = {}

    def counted(members):
        return sum(x is not None for _, x in members), sum(x == "block" for _, x in members)

    def walk(host, node, share, level, members):
        branches = defaultdict(list)
        for segs, label in members:
            if len(segs) > level:
                branches[segs[level]].append((segs, label))
            else:
                out[host, segs] = (node, share)
        n = sum(map(len, branches.values()))
        bins = defaultdict(list)
        for seg, own in branches.items():
            l, b = counted(own)
            if l:
                bins[b * o.bins // l].append(seg)
                continue
            name = "*" if not seg.startswith("{") and len(own) * o.max_children < n else seg
            for segs, _ in own:
                out[host, segs] = (f"{node}/{name}", share)
        runs = []
        for _, segs in sorted(bins.items()):
            own = [x for s in segs for x in branches[s]]
            if runs:
                (l0, b0), (l, b) = counted(runs[-1][1]), counted(own)
                pooled = (b + b0 + 1.0) / (l + l0 + 2.0)
                if abs(b / l - b0 / l0) <= o.z * math.sqrt(pooled * (1.0 - pooled) * (1.0 / l + 1.0 / l0)):
                    runs[-1][0].extend(segs)
                    runs[-1][1].extend(own)
                    continue
            runs.append((list(segs), own))
        for segs, own in runs:
            l, b = counted(own)
            name = min(segs) + (f"|+{len(segs) - 1}" if len(segs) > 1 else "")
            walk(host, f"{node}/{name}", (b + o.smoothing * share) / (l + o.smoothing), level + 1, own)

    for host, members in hosts.items():
        l, b = counted(members)
        share = (b + o.smoothing * root) / (l + o.smoothing)
        if l:
            walk(host, "", share, 0, members)
        else:
            out |= {(host, segs): ("", share) for segs, _ in members}
    return {k: (node or "/", share) for k, (node, share) in out.items()}


def check(spark, urls, options=uf.TreeOptions()):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n long")
    got = {r.page_id: r for r in uf.judge_urls(df, options=options).collect()}
    assert len(got) == len(urls)
    rows = []
    for u in urls:
        host, path = split_url(u)
        rows.append((host, segments(path), rule_of(host, path)[0]))
    want = brute(rows, options)
    for i, u in enumerate(urls):
        host, path = split_url(u)
        what, rule = rule_of(host, path)
        template, share = want[rows[i][:2]]
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.template == template and r.blocked_share == pytest.approx(share, abs=1e-12)
        assert r.verdict == (what or ("block" if share > options.worst else "allow"))
    return got


def test_against_plain_tree(spark):
    rnd = random.Random(4)
    words = ["fr", "de", "en", "es", "tag", "user", "shop"]
    urls = []
    for _ in range(1500):
        host = rnd.choice(["a.example.org", "b.example.org", "x.com", "Y.example.com", "z.net", "example.org"])
        path = "/".join(rnd.choice(words + [str(rnd.randint(0, 99)), f"w{rnd.choice('abcdefghijklmnop')}{rnd.choice('abcdefghijkl')}", f"{rnd.randint(0, 9)}.html", "deadbeef01"]) for _ in range(rnd.randint(0, 6)))
        urls.append(f"http{rnd.choice(['', 's'])}://{host}/{path}{rnd.choice(['', '?q=1', '#top', '/'])}")
    got = check(spark, urls)
    check(spark, urls[:300], uf.TreeOptions(bins=7, max_children=3, smoothing=1.0, z=0.5))
    assert {r.verdict for r in got.values() if r.rule is None} == {"allow", "block"}


def test_edges(spark):
    check(spark, [None, "", "no scheme", "://", "http://", "http://HOST", "http://example.org/es/", "http://example.org", "http://a.org?x/y", "x://y://z/a", "http://h/" + "a/" * 3000, "http://h/a\nb/c", "http://ünï.com/fr/1", "http://xorg/", None, "http://example.org/en/1"])
    none = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge_urls(none).count() == 0


def test_given_labels(spark):
    rows = [(i, f"http://q.net/spam/{i}", "block" if i < 20 else None) for i in range(40)] + [(100 + i, f"http://q.net/good/{i}", "allow" if i < 20 else None) for i in range(40)]
    got = uf.judge_urls(spark.createDataFrame(rows, "page_id long, url string, mark string"), label_col="mark").collect()
    assert {(("spam" in r.path), r.verdict) for r in got} == {(True, "block"), (False, "allow")}


def test_rare_branches_are_told_apart_by_labels(spark):
    """Rare branches without labels inherit the host's share; a rare blocked one among rare allowed ones stays blocked."""
    urls = [f"http://q.com/fr/{i}" for i in range(300)] + [f"http://q.com/{s}/{i}" for s in ("de", "es", "it", "pt") for i in range(40)] + [f"http://q.com/big/{i}" for i in range(540)]
    got = uf.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    rare = [r for r in got if r.path[:4] in ("/es/", "/it/", "/pt/")]
    assert len(rare) == 120 and {(r.rule, r.verdict) for r in rare} == {(None, "allow")}
    rows = [(f"http://h.net/{s}/{i}", "block" if s == "bad" else "allow") for s in ["bad"] + [f"ok{chr(97 + k)}" for k in range(4)] for i in range(40)] + [(f"http://h.net/bad/{i}", None) for i in range(5)] + [(f"http://h.net/main/{i}", "allow") for i in range(900)]
    got = uf.judge_urls(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, mark string"), label_col="mark").collect()
    assert {("bad" in r.path, r.verdict) for r in got} == {(True, "block"), (False, "allow")}


def judged(spark, rows):
    got = uf.judge_urls(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, mark string"), label_col="mark").collect()
    want = brute([(split_url(u)[0], segments(split_url(u)[1]), m) for u, m in rows], uf.TreeOptions())
    for r in got:
        template, share = want[r.host, segments(r.path)]
        assert r.template == template and r.blocked_share == pytest.approx(share, abs=1e-12)
    return got


def test_a_drift_of_shares_is_not_one_branch(spark):
    rows = [(f"http://d.net/{chr(97 + k)}/{i}", "block" if i < 4 * k else "allow") for k in range(11) for i in range(40)]
    got = judged(spark, rows)
    assert {r.verdict for r in got if r.path < "/d"} == {"allow"} and {r.verdict for r in got if r.path > "/h"} == {"block"}
    assert len({r.template for r in got}) >= 3


def test_deep_branches_are_told_apart(spark):
    rows = [(f"http://d.net/a/b/c/d/e/f/{s}/{i}/x", "block" if s == "bad" else "allow") for s in ("bad", "good") for i in range(30)]
    rows += [(f"http://d.net/{'q/' * 9}{s}/{i}", "block" if s == "bad" else "allow") for s in ("bad", "good") for i in range(30)]
    got = judged(spark, rows)
    assert {("bad" in r.path, r.verdict) for r in got} == {(True, "block"), (False, "allow")}


def test_very_long_paths_are_walked_to_their_end(spark):
    """No depth ends the tree: labelled paths of hundreds of segments, alone and beside others, and one with unlabelled ones below it."""
    long = "/".join(chr(97 + i % 26) for i in range(400))
    rows = [(f"http://d.net/{long}", "block"), (f"http://c.net/z/{long}", "allow"), (f"http://e.net/k/{long}/p", "block"), (f"http://e.net/k/{long}/p", None)]
    rows += [(f"http://f.net/{'q/' * 3}{s}/{long}", "block" if s == "bad" else "allow") for s in ("bad", "good") for i in range(30)]
    rows += [("http://g.net/a", "block")] * 5 + [("http://g.net/a/b/c", None), ("http://g.net/d/e", None)]
    got = judged(spark, rows)
    assert {("bad" in r.path, r.verdict) for r in got if r.host == "f.net"} == {(True, "block"), (False, "allow")}
    assert {r.template for r in got if r.host in ("c.net", "d.net")} == {f"/{long}", f"/z/{long}"}
    assert {r.template for r in got if r.host == "g.net"} == {"/a", "/a/b", "/d"}


def test_many_labelled_branches_have_short_names(spark):
    rows = [(i, f"http://m.net/{chr(97 + i // 26)}{chr(97 + i % 26)}x/y", "block") for i in range(100)]
    got = uf.judge_urls(spark.createDataFrame(rows, "page_id long, url string, mark string"), label_col="mark").collect()
    assert {(r.template, r.verdict) for r in got} == {("/aax|+99/y", "block")}


def test_id_columns_that_clash(spark):
    df = spark.createDataFrame([(7, "http://a.org/x")], "a long, url string")
    assert [r.segs for r in uf.judge_urls(df.withColumnRenamed("a", "segs"), id_col="segs").collect()] == [7]
    with pytest.raises(ValueError, match="host"):
        uf.judge_urls(df.withColumnRenamed("a", "host"), id_col="host")


@pytest.mark.parametrize("parts", [2, 1024])
def test_hot_paths_get_the_templates_of_others(spark, monkeypatch, parts):
    """One path in most rows, repeated and null ids; with two parts it alone is hot, with 1024 all are, and long ones never."""
    monkeypatch.setattr(uf, "HOT_PATHS", parts)
    monkeypatch.setattr(uf, "HOT_LETTERS", 200)
    urls = ["http://a.com/de/x"] * 60 + ["http://a.com/fr/y"] * 20 + [f"http://a.com/de/{'z' * k}" for k in (1, 300)] + [None, "none", "http://b.net/q"]
    rows = [(None if i % 7 == 0 else i // 2, u) for i, u in enumerate(urls)]
    got = uf.judge_urls(spark.createDataFrame(rows, "page_id long, url string"))
    monkeypatch.setattr(uf, "HOT_PATHS", 0)  # none is hot
    plain = uf.judge_urls(spark.createDataFrame(rows, "page_id long, url string"))
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert order(got) == order(plain) and len(order(got)) == len(rows)
    assert all(r.template is not None and r.blocked_share is not None for r in got.collect())
