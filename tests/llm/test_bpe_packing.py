from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from strandline.llm import bpe, packing  # noqa: E402


def odd_texts(n, seed=3):
    rnd = random.Random(seed)
    alphabet = "ab \n\t  'sé€😀0 19.,!　\xa0\x1cć<|>"
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    out += ["".join(rnd.choice("aab") for _ in range(rnd.randint(1, 200))) for _ in range(n // 4)]
    return [*out, *("a" * k for k in range(1, 120)), "ab" * 500, "x" * 100_000, " " * 5000, "  a  ", "a ", " ", "", "\n\n \n", "a 's it's", "<|endoftext|> x", "a  <|endoftext|>", "a  b   c \n d"]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_codec_equals_library(name):
    import tiktoken

    ranks = bpe.load_ranks(P.path(name))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Codec(ranks, P.PATTERN)
    for text in odd_texts(3000):
        ids = ours.encode(text)
        assert list(memoryview(ids).cast("I")) == theirs.encode_ordinary(text), text[:80]
        assert ours.decode(ids) == text.encode()


def test_small_vocabularies_against_merging():
    """Random vocabularies, some with entries that merges never reach, against merging by rank itself."""
    rnd = random.Random(8)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 256 + rnd.randint(1, 14):
            new = (rnd.choice(tokens[97:100]) + rnd.choice(tokens[97:100])) if rnd.random() < 0.4 or len(tokens) < 258 else rnd.choice(tokens[256:] + tokens[97:100]) + rnd.choice(tokens[256:] + tokens[97:100])
            if new not in tokens:
                tokens.append(new)
        if rnd.random() < 0.5:
            tokens.append(b"abcabcab")
        ranks = {t: i for i, t in enumerate(tokens)}
        coder = bpe.Backtracker(ranks)
        for _ in range(60):
            piece = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 14)))
            parts = [piece[i : i + 1] for i in range(len(piece))]
            if piece in ranks:
                parts = [piece]
            else:
                while bpe._merge_once(parts, ranks, len(ranks)):
                    pass
            assert coder.encode(piece) == [ranks[p] for p in parts]


def test_missing_bytes():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Backtracker({b"a": 0})


def test_memo_keeps_what_is_used():
    made = []
    memo = bpe._Memo(lambda k: made.append(k) or k * 2, 3)
    for k in (1, 2, 3, 4, 1, 5, 6, 1):
        assert memo[k] == k * 2
    assert made.count(1) == 1 and len(memo) <= 3


def test_round_trip_operator(spark):
    texts = [None, *odd_texts(40)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "twice", "x", 1), (3, "twice", "y", 2), (3, "twice", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")
    got = bpe.bpe_round_trip(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_ids=True)
    found = defaultdict(list)
    for r in got.collect():
        found[r.doc_id].append(r)
    assert sum(map(len, found.values())) == len(rows) and len(found[3]) == 3
    for i, t in enumerate(texts):
        r = found[i][0]
        assert r.n_tokens == len(r.ids) and hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.bpe_round_trip(df.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_piece_lengths():
    for n in (0, 1, 2, 3, 7, 1023, 1024, 1025, 5000):
        lengths = packing.piece_lengths(n)
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 1024 for x in lengths) and lengths == sorted(lengths, reverse=True)
    with pytest.raises(ValueError, match="power of two"):
        packing.piece_lengths(5, 1000)


def test_packing_against_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [None, "", *odd_texts(60), "word " * 30_000]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(None, "n", "x", 5), (2, texts[2], "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, length long").repartition(5)
    got = packing.pack(df, P.path("byte_bpe_50k.json")).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    pieces = defaultdict(list)
    for r in got:
        assert r.offset == 0 and r.length == len(r.ids) == 1 << r.bucket and r.length <= 1024
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append(r)
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        if i != 2:
            own = sorted(pieces[i], key=lambda r: r.start)
            assert [x for r in own for x in r.ids] == want and {r.doc_tokens for r in own} == {len(want)}
            assert [r.start for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    assert packing.pack_digests(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_other_tokenizer_files(spark):
    """A file whose ids are not ranks is left to the tokenizers library."""
    from tokenizers import Tokenizer

    spec = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    ours = packing._Tokenizer(spec)
    assert ours.fast is None
    want = Tokenizer.from_str(spec).encode("Some plain words", add_special_tokens=False).ids
    assert list(memoryview(ours("Some plain words")).cast("I")) == want
