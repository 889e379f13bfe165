"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text. The hash of a
word comes from prefix sums of a polynomial over the bytes, so no word becomes a Python object.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")
_IS_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
_IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_UP = np.ones(1, "u8")
_DOWN = np.ones(1, "u8")
_STEP = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], "u8")
#: Texts are taken together until they have so many bytes; a longer text is taken alone.
SLICE_BYTES = 1 << 18


def words_of(text: str) -> list[str]:
    """The plain form of what word_hashes() sees."""
    return WORD.findall(text.lower())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, SLICE_BYTES + 4096)
        _UP = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(size - 1, _BASE, "u8")]), dtype="u8")
        _DOWN = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(size - 1, _INVERSE, "u8")]), dtype="u8")
    return _UP, _DOWN


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hashes of all words, in order; bounds: words of text i are hashes[bounds[i]:bounds[i + 1]]).

    With prefixes also, for each such number of bytes, the hashes of the words' beginnings; 0 for words not longer than that.
    """
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", "u1")
    at = np.cumsum([0] + [len(p) + 1 for p in parts])
    inside = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view("i1")))
    first, last = edge[::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.cumsum((data.astype("u8") + np.uint64(1)) * up[: len(data)], dtype="u8")
    sums = np.concatenate([np.zeros(1, "u8"), sums])
    hashes = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype("u8") * _STEP[0])
    stems = []
    for size in prefixes:
        long = np.flatnonzero(last - first > size)
        stem = np.zeros(len(first), "u8")
        stem[long] = mixed((sums[first[long] + size] - sums[first[long]]) * down[first[long]] + np.uint64(size * int(_STEP[1]) % (1 << 64)))
        stems.append(stem)
    return hashes, np.searchsorted(first, at), *stems


def shingle_hashes(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles of k words, with repeats; bounds by text). A text of 1 to k - 1 words is one shingle."""
    words, bounds = word_hashes(texts)
    n = np.diff(bounds)
    padded = np.concatenate([words, np.zeros(k, "u8")])
    made = np.zeros(len(words), "u8")
    for j in range(k):
        own = padded[j : j + len(words)]
        made += (own if j == 0 else mixed(own + np.uint64(j))) * _STEP[j % len(_STEP)]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # the missing words are zeros, not the words of the next text
        total = np.zeros(len(short), "u8")
        for j in range(k):
            own = np.where(j < n[short], padded[bounds[short] + j], np.uint64(0))
            total += (own if j == 0 else mixed(own + np.uint64(j))) * _STEP[j % len(_STEP)]
        made[bounds[short]] = total
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    new = np.concatenate([[0], np.cumsum(counts)])
    pick = np.repeat(bounds[:-1] - new[:-1], counts) + np.arange(new[-1])
    return mixed(made[pick]), new


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
