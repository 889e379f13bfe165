"""Toxicity: a logistic classifier on words, regularised by counterfactual identity swaps.

For each training text that names a group (an identity term), the same text with another term of that family must get
nearly the same logit: the squared change, over all features that the swap changes, is penalised. So a term that merely stands in many toxic texts earns no
weight of its own, while words that are toxic whoever they are about keep theirs. A neutral word is one of each family,
so that a mention of a group scores like none, not just like that of another group.

Only texts give a score. Fitting uses a bounded sample of labelled rows (``sample``, by hash order). Texts of the same set of
words share the weight of one, each with its own label, so copies do not outvote other texts and none is left out.
Features are the words and word beginnings (of 4, 5 and 6 bytes, so that inflected forms share one) whose association
with the label is strongest by the chi-square statistic, plus all identity terms. Scoring is one pass over the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, python_workers

#: Families of identity terms, in English, German, French and Spanish; within a family each may be swapped for any other.
IDENTITY_FAMILIES: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf"),
    ("old", "young", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "flüchtlinge", "einwanderer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("étrangers", "réfugiés", "immigrés", "autochtones"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("extranjeros", "refugiados", "inmigrantes", "nativos"),
)


#: Bytes of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class Model:
    """words: sorted 64-bit word hashes; weights: theirs; bias. gap: mean absolute logit change over the fitted swaps."""

    words: tuple[int, ...]
    weights: tuple[float, ...]
    bias: float
    gap: float = 0.0


def fit_logistic(docs: list, labels, shares, n_features: int, pairs, l2: float = 1.0, swap_penalty: float = 1.0, rounds: int = 30):
    """(weights, bias) by Newton steps. docs: arrays of feature numbers; shares: what each counts; pairs: (lost, gained, times) swaps of features for others."""
    import numpy as np

    y, share = np.asarray(labels, "f8"), np.asarray(shares, "f8")
    x = np.zeros((len(docs), n_features + 1), "f4")
    x[:, -1] = 1
    for i, features in enumerate(docs):
        x[i, features] = 1
    ridge = np.full(n_features + 1, l2)
    ridge[-1] = 1e-6
    fixed = np.diag(ridge)
    for lost, gained, times in pairs:  # the squared change of the logit, (sum of lost - sum of gained)^2
        change = np.zeros(n_features + 1)
        change[lost], change[gained] = 1.0, -1.0
        own = np.flatnonzero(change)
        fixed[np.ix_(own, own)] += swap_penalty * times * np.outer(change[own], change[own])
    w = np.zeros(n_features + 1)
    w[-1] = np.log((share @ y + 0.5) / (share @ (1 - y) + 0.5))

    def loss(w):
        z = x @ w
        return float(share @ (np.logaddexp(0, z) - y * z) + 0.5 * w @ fixed @ w)

    at = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (share * (p - y)) + fixed @ w
        s = (share * p * (1 - p)).astype("f4")
        hessian = np.zeros_like(fixed)
        for i in range(0, len(docs), 2048):
            part = x[i : i + 2048]
            hessian += part.T @ (part * s[i : i + 2048, None])
        step = np.linalg.solve(hessian + fixed + 1e-9 * np.eye(len(w)), gradient)
        size = 1.0
        while size > 1e-6 and (new := loss(w - size * step)) > at:
            size /= 2
        if size <= 1e-6 or at - new < 1e-6 * max(1.0, abs(at)):
            break
        w, at = w - size * step, new
    return w[:-1], float(w[-1])


def _features_of(hashed: tuple) -> list:
    """The word and the word beginnings of one hashed word; what word_hashes() gives as 0 is no beginning."""
    word, _, *stems = hashed
    return [word, *(s for s in stems if len(s) and s[0] != 0)]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = 20_000,
    features: int = 512,
    least_docs: int = 4,
    least_chi_square: float = 10.0,
    l2: float = 0.05,
    swap_penalty: float = 1.0,
    families: tuple[tuple[str, ...], ...] = IDENTITY_FAMILIES,
) -> Model | None:
    """A model from rows of labels that have a document, or None if these do not hold both labels.

    At most ``sample`` labelled ids are used, those with the least hash. Rows with a null id or label are no labels; of
    several labels of an id the larger counts; of several documents of an id one is used. A feature needs ``least_docs``
    texts of different words and a chi-square of ``least_chi_square`` at least; the ``features`` strongest ones are taken.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    python_workers(spark)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # of ``sample`` rows

    def words(batches):
        from strandline.llm.bpe import rows_of
        from strandline.llm.textvec import mixed, slices, word_hashes

        np.seterr(over="ignore")
        for batch in batches:
            label, done = batch.column(2), 0
            for ids, texts in rows_of(batch, 64):
                texts = [t or "" for t in texts]
                seen, prints = [], []
                for a, b in slices(texts):
                    w, at, *stems = word_hashes(texts[a:b], STEMS)
                    for i in range(b - a):
                        own = np.unique(np.concatenate([x[at[i] : at[i + 1]] for x in (w, *stems)]))
                        own = own[own != 0]
                        seen.append(own.view("i8"))
                        prints.append(int(mixed(own).sum(dtype="u8").astype("i8")))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), label.slice(done, len(ids)), pa.array(prints, pa.int64()), pa.array(seen, pa.list_(pa.int64()))], names=["id", "label", "print", "words"])
                done += len(ids)

    seen = rows.mapInArrow(words, "id long, label int, print long, words array<long>").withColumn("at", F.monotonically_increasing_id())
    seen = materialize(seen, "toxic-words")
    # one document of each id; texts of the same words share one's weight. Only these narrow rows are shuffled, at most ``sample``
    one = F.min_by(F.struct("label", "print"), "at")
    picks = materialize(seen.groupBy("id").agg(F.min("at").alias("at"), one.alias("one")).select("at", "one.label", "one.print"), "toxic-picks")
    copies = picks.groupBy("print").agg((F.lit(1.0) / F.count(F.lit(1))).alias("share"))
    picks = picks.join(F.broadcast(copies), "print").select("at", (F.col("label") > 0).cast("double").alias("one"), "share")
    ones, n, rows_of_one, n_rows = picks.agg(F.sum(F.col("one") * F.col("share")), F.sum("share"), F.sum("one"), F.count(F.lit(1))).first()
    if not n_rows or rows_of_one in (0, n_rows):
        return None

    in_texts = seen.select("at", "words").join(F.broadcast(picks), "at").select("at", "one", "share", F.explode("words").alias("word"))
    counts = in_texts.groupBy("word").agg(F.sum(F.col("one") * F.col("share")).alias("ones"), F.sum("share").alias("has"))
    # chi-square of the two by two table: n (ad - bc)^2 / (rows x columns)
    a, has = F.col("ones"), F.col("has")
    cross = a * F.lit(n - ones) - (has - a) * F.lit(ones)
    score = F.round(F.lit(n) * cross * cross / (has * (F.lit(n) - has) * F.lit(ones * (n - ones))), 6)
    best = counts.filter((has >= least_docs - 1e-6) & (has < n - 1e-6)).filter(score >= least_chi_square).orderBy(score.desc(), "word").limit(features)
    chosen = [r["word"] for r in best.collect()]  # of ``features`` rows

    from strandline.llm.textvec import word_hashes

    terms = sorted({t for family in families for t in family})
    forms = {t: [int(x.view("i8")[0]) for x in _features_of(word_hashes([t], STEMS))] for t in terms}  # the word, and its beginnings
    hash_of = {t: forms[t][0] for t in terms}
    vocabulary = sorted({*chosen, *hash_of.values()})
    numbers = spark.createDataFrame(list(zip(vocabulary, range(len(vocabulary)), strict=True)), "word long, number int")
    hits = in_texts.join(F.broadcast(numbers), "word").groupBy("at").agg(F.array_sort(F.collect_list("number")).alias("features"))
    got = picks.join(hits, "at", "left").orderBy("at").collect()  # at most ``sample`` rows of known features
    data, y, shares = [np.array(r["features"] or [], "i4") for r in got], [r["one"] for r in got], [r["share"] for r in got]
    number = {h: i for i, h in enumerate(vocabulary)}
    df = np.zeros(len(vocabulary))
    for own, share in zip(data, shares, strict=True):
        df[own] += share
    pairs = []
    for family in families:
        own = {t: {number[h] for h in forms[t] if h in number} for t in family}
        for a in family:
            times = float(df[number[hash_of[a]]]) / len(family)
            others = [own[b] for b in family if b != a] + [set()]  # the last is a neutral word: else all might share a weight
            pairs += [(sorted(own[a] - b), sorted(b - own[a]), times) for b in others if times]
    w, bias = fit_logistic(data, y, shares, len(vocabulary), pairs, l2, swap_penalty)
    gap = float(np.average([abs(w[a].sum() - w[b].sum()) for a, b, _ in pairs], weights=[t for *_, t in pairs])) if pairs else 0.0
    return Model(tuple(vocabulary), tuple(float(v) for v in w), bias, gap)


def _scorer(model: Model):
    """A function from a list of texts to their scores."""
    import numpy as np

    words, weights, bias = np.array(model.words, "i8"), np.array(model.weights), model.bias

    def scores(texts: list) -> np.ndarray:
        from strandline.llm.textvec import slices, word_hashes

        texts = [t or "" for t in texts]
        logits = np.full(len(texts), bias)
        for a, b in slices(texts):
            whole, at, *stems = word_hashes(texts[a:b], STEMS)
            once = []
            for w in (whole.view("i8"), *(x.view("i8") for x in stems)):
                place = np.minimum(np.searchsorted(words, w), len(words) - 1)
                hit = np.flatnonzero(words[place] == w)
                once.append((np.searchsorted(at, hit, side="right") - 1) * len(words) + place[hit])
            once = np.unique(np.concatenate(once))
            np.add.at(logits, a + once // len(words), weights[once % len(words)])
        return 1 / (1 + np.exp(-np.clip(logits, -700, 700)))

    return scores


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, score (0 to 1), predicted (1 if score >= 0.5, else 0).

    Null texts count as empty and get the score of a text without known words. Without a model every score is 0. Rows
    and null ids stay as they are; an empty table gives an empty result; other columns play no part.
    """
    import pyarrow as pa

    python_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    scorer = _scorer(model)

    def run(batches):
        from strandline.llm.bpe import rows_of

        for batch in batches:
            for ids, texts in rows_of(batch):
                scores = scorer(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype("i4"), pa.int32())], names=["id", "score", "predicted"])

    return rows.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below 0.5, with all columns: one pass, no join. Without a model all stay.

    Null texts count as empty; null ids, repeated rows and an empty table stay as they are.
    """
    if model is None:
        return docs
    python_workers(docs.sparkSession)
    scorer = _scorer(model)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(texts.tolist()))

    return docs.filter(toxic(F.coalesce(F.col(text_col), F.lit(""))) < 0.5)
