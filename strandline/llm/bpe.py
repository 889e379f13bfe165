"""Byte-level BPE: encoding by backtracking over longest matches, and decoding.

Bytes are mapped to Latin-1 so that pyahocorasick, which works on strings, finds every vocabulary entry that ends at a
byte. For each position the longest entry starting there is tried first; a shorter one follows if the pair of the last
token and this one could not stand side by side in a merged sequence, and if none fits, the last token is taken back.
Whether two tokens may be neighbours is decided by undoing their merges along the boundary, and memoised. Every
position is given up at most once, so the time is linear in the text, and the result is that of the merges themselves.

Texts are cut at spaces before the pretokenisation pattern is applied: a chunk " word" is split the same way wherever
it stands, unless white space stands on both sides of a space or a space ends the text after white space; such texts
are split whole. The ids of a chunk are kept in a bounded table, so a word that occurs often is encoded once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame

from strandline.llm.common import python_workers

#: A space with white space before it and white space or the end after it: then chunks are not independent.
_ENTANGLED = re.compile(r"\s (?:\s|\Z)")
#: Chunks whose ids a worker keeps, twice; beyond it the older half is forgotten.
MEMO_ENTRIES = 150_000
#: White space as Unicode defines it; what regex calls \s also has four control characters.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of lines 'base64 rank'."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def _merge_once(parts: list[bytes], ranks: dict[bytes, int], below: int) -> bool:
    best, at = below, -1
    for i in range(len(parts) - 1):
        rank = ranks.get(parts[i] + parts[i + 1], below)
        if rank < best:
            best, at = rank, i
    if at < 0:
        return False
    parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class Backtracker:
    """Encodes one pretokenised piece of bytes into the ids that merging by rank would give."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.whole_only: set[int] = set()
        for token, rank in ranks.items():
            if len(token) == 1:
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2 and _merge_once(parts, ranks, rank):
                pass
            if len(parts) == 2:
                pair = ranks[parts[0]], ranks[parts[1]]
                self.halves[rank] = pair
                self.merged[pair] = rank
            else:  # merges never arrive at it; it only stands for a piece that equals it
                self.whole_only.add(rank)
        self.matcher = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank not in self.whole_only:
                self.matcher.add_word(token.decode("latin-1"), (len(token), rank))
        self.matcher.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter_of: dict[int, int] = {}
        self.size_of = [0] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.size_of[rank] = len(token)

    def shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of the token, or -1."""
        text = self.bytes_of[token]
        found = -1
        for n in range(len(text) - 1, 0, -1):
            rank = self.ranks.get(text[:n])
            if rank is not None and rank not in self.whole_only:
                found = rank
                break
        self.shorter_of[token] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave left and right side by side."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= 1_000_000:
                self.compatible.clear()
            known = self.compatible[left, right] = self._undo(left, right)
        return known

    def _undo(self, left: int, right: int) -> bool:
        # The pieces that touch the boundary are taken apart, the merge made last first. If they would merge across
        # the boundary before the merge undone last, the two tokens never come to stand side by side. Of equal ranks
        # the merge further left comes first, so undoing on the right lets an equal rank across the boundary win.
        a, b, limit = left, right, None
        while True:
            across = self.merged.get((a, b))
            if across is not None and (limit is None or across < limit):
                return False
            undo_left = a in self.halves and (b not in self.halves or a > b)
            if undo_left:
                limit, a = a, self.halves[a][1]
            elif b in self.halves:
                limit, b = b + 1, self.halves[b][0]
            else:
                return True

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size_of, compatible = len(piece), self.size_of, self.compatible
        longest = [0] * n
        for end, (size, rank) in self.matcher.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank  # matches come by their ends, so what starts here and ends later is longer
        closed: set[int] = set()
        out: list[int] = []
        last, at = -1, 0
        token = longest[0] if n else 0
        while at < n:
            after = at + size_of[token]
            if after not in closed:
                fits = last < 0 or compatible.get((last, token))
                if fits is None:
                    fits = self.may_follow(last, token)
                if fits:
                    out.append(token)
                    last, at = token, after
                    token = longest[at] if at < n else 0
                    continue
            less = self.shorter_of.get(token, -2)
            if less == -2:
                less = self.shorter(token)
            if less >= 0:
                token = less
            else:
                closed.add(at)
                token = out.pop()
                at -= size_of[token]
                last = out[-1] if out else -1
                # the token taken back is tried again: its end is closed now, so a shorter one follows
        return out


class _Memo(dict):
    """A bounded table: when it is full it becomes the older half, from which what is used again comes back."""

    def __init__(self, make, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class Codec:
    """Whole texts to ids (as little-endian unsigned 32-bit integers) and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import numpy as np
        import regex

        self.piece = Backtracker(ranks)
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")).findall
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are kept as little-endian 32-bit integers")
        self.inner = _Memo(lambda chunk: self._split(" " + chunk))
        self.first = _Memo(self._split, 10_000)
        self.pieces = _Memo(lambda x: array("I", self.piece.encode(x.encode("utf-8"))).tobytes(), 400_000)
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], "i8")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(tokens), "u1")

    def _split(self, text: str) -> bytes:
        return b"".join([self.pieces[x] for x in self.find(text)])

    def encode(self, text: str) -> bytes:
        if _ENTANGLED.search(text):
            return self._split(text)
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.inner.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        tokens = np.frombuffer(ids, "<u4")
        if not tokens.size:
            return b""
        n = self.lengths[tokens]
        total = np.cumsum(n)
        return self.blob[np.repeat(self.starts[tokens] - (total - n), n) + np.arange(total[-1])].tobytes()


@lru_cache(maxsize=4)
def _codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}, pattern)


def rows_of(batch, step: int = 256) -> Iterator[tuple[list, list]]:
    """The first two columns of an Arrow batch as lists, a few rows at a time, so that only those are Python objects."""
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>).

    The text is encoded without special tokens and the ids are decoded again. Null texts count as empty: no tokens,
    digests of nothing. Rows and null ids stay as they are; an empty table gives an empty result; other columns play no
    part. The vocabulary is read by the driver and shipped with the tasks, so executors need no file.
    """
    import pyarrow as pa

    python_workers(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_bytes())  # of the vocabulary's fixed size
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def encode(batches):
        import numpy as np

        codec = _codec(vocabulary.value, pattern)
        for batch in batches:
            for ids_in, texts in rows_of(batch):
                n, first, second, lists = [], [], [], []
                for text in texts:
                    ids = codec.encode(text or "")
                    n.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        lists.append(np.frombuffer(ids, "<u4").astype("i4"))
                out = [pa.array(ids_in, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    from pyspark.sql import functions as F

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, schema).withColumnRenamed("id", id_col)
