"""Quality rules: plain counts with fixed limits, and a logistic classifier on hashed word and character n-grams.

A text's features are its word n-grams (one and two words) and character n-grams (two to four code points), each hashed into
one of ``BUCKETS`` places without any list of known n-grams. A place's value is log(1 + count), and a text's values have
length one, so that long texts weigh no more than short ones. The classifier is fitted on a bounded sample of labelled
rows (``sample``, by hash order); every fourth row of it is kept from the fit and gives the slope and offset that turn a
logit into a probability. Texts are scored in Arrow batches, and stay from ``LEAST_PROBABILITY`` on.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import python_workers
from strandline.llm.textvec import mixed, slices

BITS = 14
BUCKETS = 1 << BITS
CHARS, WORDS = (2, 3, 4), (1, 2)
#: Texts that are hashed together, so that their places stay in some 8 MB.
TOGETHER = 64
#: Fixed limits: words that a text needs, percent of its words in repeated windows, probability of good quality.
LEAST_WORDS, MOST_REPEATED, LEAST_PROBABILITY = 50, 50, 0.5
SPACES, SYMBOLS = b" \t\n\r\v\f", "#*$%&|<>"
_STEPS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], "u8")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Model:
    """weights: one for each place; bias; slope and offset of the calibration. All are of the label 1, good quality."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text. Words end at blanks and the controls 9 to 13."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at just these
    chars = len(text) - sum(text.count(chr(c)) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(SPACES.decode())]
    repeated = 0
    if len(words) > 3 and len(set(windows := list(zip(words, words[1:], words[2:], strict=False)))) < len(windows):
        often = Counter(windows)
        reach = 0  # words before this one are counted
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def _hashed(texts: list[str]) -> np.ndarray:
    """(place + BUCKETS x number of the text) of all n-grams of some texts."""
    data = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "u4") for t in texts]
    sizes = np.array([len(d) for d in data], "i8")
    points = np.concatenate([*data, np.zeros(4, "u4")]).astype("u8") + np.uint64(1)
    n = int(sizes.sum())
    owner = np.repeat(np.arange(len(texts)), sizes)
    last = np.cumsum(sizes)[owner] if n else np.zeros(0, "i8")
    at = np.arange(n)
    out = []

    def put(hashes: np.ndarray, owners: np.ndarray) -> None:
        out.append((mixed(hashes) >> np.uint64(64 - BITS)).astype("i8") + owners * BUCKETS)

    for k in CHARS:
        h = np.full(n, k, "u8")
        for j in range(k):
            h = (h ^ points[j : j + n]) * _STEPS[j]
            h ^= h >> np.uint64(29)
        inside = at + k <= last
        put(h[inside], owner[inside])

    code = points[:n] - np.uint64(1)
    inside = ~((code == 32) | ((code >= 9) & (code <= 13)))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    first_of_text = np.zeros(n + 1, bool)
    first_of_text[starts[sizes > 0]] = True
    begins = np.flatnonzero(inside & (first_of_text[:n] | ~np.concatenate([[False], inside[:-1]]))) if n else at
    ends = np.flatnonzero(inside & (first_of_text[1:] | (at + 1 == n) | ~np.concatenate([inside[1:], [False]]))) + 1 if n else at
    up = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, _BASE)]), dtype="u8")
    down = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, _INVERSE)]), dtype="u8")
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(points[:n] * up[:n], dtype="u8")])
    words = mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype("u8") * _STEPS[1])
    of = owner[begins]
    for k in WORDS:
        h = np.full(max(len(words) - k + 1, 0), 16 + k, "u8")
        for j in range(k):
            h = (h ^ words[j : j + len(h)]) * _STEPS[j]
            h ^= h >> np.uint64(31)
        whole = of[: len(h)] == of[k - 1 : k - 1 + len(h)]
        put(h[whole], of[: len(h)][whole])
    return np.concatenate(out)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, places, values) of some texts: text i has places[bounds[i]:bounds[i + 1]], its values have length one."""
    counts = np.bincount(_hashed(texts), minlength=len(texts) * BUCKETS)
    found = np.flatnonzero(counts)
    values = np.log1p(counts[found])
    owner = found >> BITS
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    norms = np.sqrt(np.bincount(owner, values * values, minlength=len(texts)))
    return bounds, (found & (BUCKETS - 1)).astype("u2"), (values / norms[owner]).astype("f4")


def _together(texts: list[str]):
    """Ranges of texts that are hashed at once."""
    for a, b in slices(texts):
        for i in range(a, b, TOGETHER):
            yield i, min(i + TOGETHER, b)


def logits(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts), bias)
    with np.errstate(over="ignore"):
        for a, b in _together(texts):
            bounds, places, values = features(texts[a:b])
            sums = np.concatenate([[0.0], np.cumsum(values * weights[places])])
            out[a:b] += sums[bounds[1:]] - sums[bounds[:-1]]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def probabilities(texts: list, model: Model) -> np.ndarray:
    """The calibrated probability of good quality of each text; null counts as empty."""
    return _sigmoid(model.slope * logits([t or "" for t in texts], model.weights, model.bias) + model.offset)


def fit(bounds: np.ndarray, places: np.ndarray, values: np.ndarray, y: np.ndarray, l2: float, rounds: int = 80, memory: int = 8) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the logistic loss plus l2 / 2 times the squared weights, by limited-memory BFGS."""
    block = 1024

    def at(w):
        loss, gradient = 0.5 * l2 * float(w[:-1] @ w[:-1]), np.concatenate([l2 * w[:-1], [0.0]])
        for i in range(0, len(y), block):  # in blocks of rows, so that what is held beside the features stays small
            j = min(i + block, len(y))
            own = slice(bounds[i], bounds[j])
            sums = np.concatenate([[0.0], np.cumsum(values[own] * w[places[own]])])
            z = sums[bounds[i + 1 : j + 1] - bounds[i]] - sums[bounds[i:j] - bounds[i]] + w[-1]
            loss += float(np.sum(np.logaddexp(0, z) - y[i:j] * z))
            r = _sigmoid(z) - y[i:j]
            gradient[:-1] += np.bincount(places[own], values[own] * np.repeat(r, np.diff(bounds[i : j + 1])), minlength=BUCKETS)
            gradient[-1] += r.sum()
        return loss, gradient

    w = np.zeros(BUCKETS + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    loss, g = at(w)
    steps: list = []
    for _ in range(rounds):
        d, kept = g.copy(), []
        for s, t, rho in reversed(steps):
            kept.append(a := rho * (s @ d))
            d -= a * t
        if steps:
            s, t, _ = steps[-1]
            d *= (s @ t) / (t @ t)
        for (s, t, rho), a in zip(steps, reversed(kept), strict=True):
            d += (a - rho * (t @ d)) * s
        size = 1.0 if steps else 1.0 / max(1.0, float(np.linalg.norm(g)))
        while size > 1e-8:
            new, gradient = at(w - size * d)
            if new <= loss - 1e-4 * size * float(g @ d):
                break
            size /= 2
        else:
            break
        s, t = -size * d, gradient - g
        done = loss - new < 1e-7 * max(1.0, abs(loss))
        w, loss, g = w + s, new, gradient
        if done:
            break
        if s @ t > 1e-12:
            steps = [*steps, (s, t, 1 / (s @ t))][-memory:]
    return w[:-1], float(w[-1])


def calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of the probability of label 1 given a logit, fitted to targets drawn in by one row of either label."""
    ones = y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x = np.stack([z, np.ones(len(z))], 1)
    w = np.array([1.0, 0.0])

    def loss(w):
        return float(np.sum(np.logaddexp(0, x @ w) - target * (x @ w)) + 1e-3 * (w[0] - 1) ** 2)

    for _ in range(rounds):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - target) + 2e-3 * np.array([w[0] - 1, 0.0])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([2e-3, 1e-9]), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4_000, l2: float = 0.02) -> Model | None:
    """A model from rows of labels that have a document, or None if these do not hold both labels.

    At most ``sample`` labelled ids are used, those with the least hash. Rows with a null id or label are no labels; of
    several labels of an id the smaller counts; of several documents of an id the first text in order is used.
    """
    import pyarrow as pa

    python_workers(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # known has ``sample`` rows at most

    def vectors(batches):
        np.seterr(over="ignore")
        for batch in batches:
            own = batch.column(2).to_pylist()
            for a, b in _together(own):
                bounds, places, values = features(own[a:b])
                cut = [slice(*bounds[i : i + 2]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([places[c].tobytes() for c in cut], pa.binary()), pa.array([values[c].tobytes() for c in cut], pa.binary())], names=["id", "label", "places", "values"])

    got = texts.select("id", "label", "text").mapInArrow(vectors, "id long, label int, places binary, values binary").toArrow()  # at most ``sample`` rows of at most BUCKETS places
    if not got.num_rows:
        return None
    ids = got.column("id").to_numpy()
    order = np.lexsort([ids, mixed(ids.astype("u8"))])  # the same rows in the same order, however they were dealt
    y = (got.column("label").to_numpy()[order] > 0).astype("f8")
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held])) < 2:
        return None
    places = [np.frombuffer(got.column("places")[int(i)].as_py(), "u2") for i in order]
    values = [np.frombuffer(got.column("values")[int(i)].as_py(), "f4") for i in order]
    del got

    def rows(chosen: np.ndarray):
        numbers = np.flatnonzero(chosen)
        return np.cumsum([0, *(len(places[i]) for i in numbers)]), np.concatenate([places[i] for i in numbers]), np.concatenate([values[i] for i in numbers])

    weights, bias = fit(*rows(~held), y[~held], l2)
    if len(set(y[held])) < 2:
        return Model(weights, bias, 1.0, 0.0)
    bounds, at, x = rows(held)
    sums = np.concatenate([[0.0], np.cumsum(x * weights[at])])
    return Model(weights, bias, *calibrate(sums[bounds[1:]] - sums[bounds[:-1]] + bias, y[held]))


def judge(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    kept: not base_failed, and the classifier's probability of good quality (quality) is LEAST_PROBABILITY at least.
    Without a model, quality is null and the counts decide alone. Null texts count as empty, so they have no words and
    fail. Rows and null ids stay as they are; an empty table gives an empty result; other columns play no part.
    """
    import pyarrow as pa

    python_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        from strandline.llm.bpe import rows_of

        for batch in batches:
            for ids, texts in rows_of(batch):
                counts = [text_counts(t) for t in texts]
                failed = [base_failed(c[0], c[4]) for c in counts]
                good = probabilities(texts, model) if model else None
                kept = [not f and (good is None or good[i] >= LEAST_PROBABILITY) for i, f in enumerate(failed)]
                columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
                quality = pa.nulls(len(ids), pa.float64()) if good is None else pa.array(good, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns, pa.array(failed), pa.array(kept, pa.bool_()), quality], names=["id", *counted, "base_failed", "kept", "quality"])

    return rows.mapInArrow(run, f"id long, {', '.join(f'{c} long' for c in counted)}, base_failed boolean, kept boolean, quality double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all columns: one pass, no join."""
    python_workers(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        own = texts.tolist()
        counts = [text_counts(t) for t in own]
        enough = probabilities(own, model) >= LEAST_PROBABILITY if model else np.ones(len(own), bool)
        return pd.Series([bool(e) and not base_failed(c[0], c[4]) for c, e in zip(counts, enough, strict=True)], dtype="bool")

    return docs.filter(good(F.coalesce(F.col(text_col), F.lit(""))))
