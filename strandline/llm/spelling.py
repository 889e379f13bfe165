"""Spelling variant grouping: words one letter apart, found by wildcard groups instead of pairs.

1. Words: each task counts the runs of its texts; words with enough letters and occurrences are numbered in code-point
   order, so that a number stands for a word and ties fall the right way.
2. Replacements: a word belongs to one group for each of its letters, all that is before and after it. Members of a group
   differ in that letter alone, so a group has no more members than the alphabet has letters. It keeps its size and
   its two most frequent words: a member has size - 1 near words there, the best being the first or, for that, the second.
3. Insertions and deletions: what is left of a word without one letter is looked up among the words, a row for each hit.
4. Each word's counts and best near words are summed up; a form is followed to its root by doubling the steps.

Words of more than ``PLAIN`` letters are keyed by a polynomial hash modulo the prime 2^127 - 1 of what a key would
spell, so that the keys of a word stay linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, python_workers

#: Distinct words that a task holds before it hands them on.
MOST_HELD = 200_000
#: Up to so many letters, keys are the letters themselves.
PLAIN = 64
_PRIME = (1 << 127) - 1
_BASE = 0x2545F4914F6CDD1D9E3779B97F4A7C15
WILDCARD = "*"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7, slip: int = 31) -> DataFrame:
    """(word, n) with one row for each task that met the word, or a few.

    Runs are maximal in A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. A run whose checksum (crc32 of
    '<id>:<run>') is a multiple of slip loses the letter at checksum mod length. A null id counts as an empty one.
    """
    import pyarrow as pa

    python_workers(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def count(batches):
        import re
        from collections import Counter
        from zlib import crc32

        runs = re.compile(f"[a-zÀ-ÿ]{{{least_letters},}}").findall  # shorter runs can't become longer
        words: Counter = Counter()

        def told():
            items = list(words.items())
            words.clear()
            for i in range(0, len(items), 65_536):
                some, n = zip(*items[i : i + 65_536], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(1), strict=True):
                start = crc32(own.as_py() + b":")
                found = Counter(runs(text.as_py().lower().decode("utf-8", "replace")))  # bytes are lower-cased in A-Z alone
                for run, n in found.items():
                    h = crc32(run.encode(), start)
                    if h % slip == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_letters:
                            continue
                    words[run] += n
                if len(words) > MOST_HELD:
                    yield from told()
        yield from told()

    return rows.mapInArrow(count, "word string, n long")


def long_keys(word: str):
    """(kind, key) of a word of more than PLAIN letters, in time linear in its length. A key of more than PLAIN letters is '#length:hash'."""
    size = len(word)
    powers, ahead = [1], [0]
    for c in word:
        powers.append(powers[-1] * _BASE % _PRIME)
        ahead.append((ahead[-1] * _BASE + ord(c)) % _PRIME)
    yield "word", f"#{size}:{ahead[-1]:032x}"
    for i, c in enumerate(word):
        h = (ahead[-1] + (ord(WILDCARD) - ord(c)) * powers[size - 1 - i]) % _PRIME
        yield "wild", f"#{size}:{h:032x}:{i}"
        if i and c == word[i - 1]:
            continue  # the same letters are left as without the one before
        if size - 1 <= PLAIN:
            yield "less", word[:i] + word[i + 1 :]
        else:
            rest = (ahead[-1] - ahead[i + 1] * powers[size - 1 - i]) % _PRIME
            yield "less", f"#{size - 1}:{(ahead[i] * powers[size - 1 - i] + rest) % _PRIME:032x}"


def _keys(words: DataFrame, kind: str, least_letters: int) -> DataFrame:
    """(key, number, n) for each key of a kind: what a word is looked up by (word), its wildcard groups (wild), or what is left of it without a letter (less)."""
    import pyarrow as pa

    size, at = F.char_length("word"), F.sequence(F.lit(1), F.char_length("word"))

    def without(i: Column, sign: str) -> Column:
        return F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.lit(sign), F.substring(F.col("word"), i + 1, size))

    short = words.filter(size <= PLAIN)
    if kind == "less":  # below least_letters there is no word to be found
        keys = F.array_distinct(F.transform(at, lambda i: without(i, "")))
        short = short.filter(size > least_letters)
    else:
        keys = F.transform(at, lambda i: without(i, WILDCARD)) if kind == "wild" else F.array("word")
    short = short.select(F.explode(keys).alias("key"), "number", "n")

    def far(batches):
        def batch_of(keys, number, n):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([number] * len(keys), pa.int64()), pa.array([n] * len(keys), pa.int64())], names=["key", "number", "n"])

        for batch in batches:
            for word, number, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = []
                for of, key in long_keys(word):
                    if of == kind:
                        keys.append(key)
                    if len(keys) == 16_384:
                        yield batch_of(keys, number, n)
                        keys = []
                yield batch_of(keys, number, n)

    return short.unionByName(words.filter(size > PLAIN).select("word", "number", "n").mapInArrow(far, "key string, number long, n long"))


def near_counts(words: DataFrame, least_letters: int) -> DataFrame:
    """(number, n_near, best: struct<minus n, number>) of the words that have near ones, for words of (number, word, n)."""
    member = F.struct((-F.col("n")).alias("minus"), "number")
    groups = _keys(words, "wild", least_letters).groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("members"))  # variants of one letter, so no more than there are letters
    groups = groups.filter(F.size("members") > 1).select((F.size("members") - 1).cast("long").alias("others"), F.slice("members", 1, 2).alias("top"), F.explode("members").alias("own"))
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    replaced = groups.select(F.col("own.number").alias("number"), F.col("others").alias("n_near"), F.when(first == F.col("own"), second).otherwise(first).alias("best"))

    known = _keys(words, "word", least_letters).select("key", member.alias("short"))
    hits = _keys(words, "less", least_letters).select("key", member.alias("long")).join(known, "key")
    sides = F.array(F.struct(F.col("short.number").alias("number"), F.col("long").alias("best")), F.struct(F.col("long.number").alias("number"), F.col("short").alias("best")))
    moved = hits.select(F.explode(sides).alias("s")).select("s.number", F.lit(1).cast("long").alias("n_near"), "s.best")
    return replaced.unionByName(moved).groupBy("number").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(number, root) for rows of (number, form): forms followed to the last one. A form is ten times as frequent, so chains are short.

    Each round doubles the steps that a row has gone, until no row can go on.
    """
    gone = materialize(forms.select("number", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = gone.select(F.col("number").alias("root"), F.col("root").alias("next"))
        further = materialize(gone.join(ahead, "root", "left").select("number", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if further.filter("moved").isEmpty():
            return gone
        gone = further.select("number", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7, least_n: int = 2, times: int = 10, slip: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of least_letters letters and least_n occurrences.

    A word's form is its most frequent near word, the first in code-point order of several, if that is ``times`` as
    frequent as the word; else form and form_n are null. root is the end of the chain of forms, or the word itself.
    Null texts have no words; every row counts, repeated ones too; a null id counts as an empty one; very long runs are
    words like any other; an empty table gives an empty result; other columns play no part, whatever their names.
    """
    counted = count_words(docs, id_col, text_col, least_letters, slip).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)
    counted = materialize(counted, "spelling-counts")
    words = materialize(counted.orderBy("word").select("word", "n", F.monotonically_increasing_id().alias("number")), "spelling-words")
    near = near_counts(words, least_letters)
    judged = words.join(near, "number", "left")
    n_best = -F.col("best.minus")
    has_form = F.coalesce(n_best >= F.lit(times).cast("long") * F.col("n"), F.lit(False))
    judged = judged.select("number", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has_form, F.col("best.number")).alias("form"), F.when(has_form, n_best).alias("form_n"))
    judged = materialize(judged, "spelling-judged")
    held = judged.filter("form IS NOT NULL")
    ends = held.select("number", "form").join(roots(held.select("number", "form")), "number")
    names = words.select("number", "word")
    ends = ends.join(names.select(F.col("number").alias("form"), F.col("word").alias("form_word")), "form").join(names.select(F.col("number").alias("root"), F.col("word").alias("root_word")), "root")
    out = judged.drop("form").join(ends.select("number", "form_word", "root_word"), "number", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
