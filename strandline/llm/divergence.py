"""Source divergence audit: how far the word use of a language's sources lies apart, by wide term vectors.

1. Counts: each task counts the terms of its texts by (lang, source) and hands on one row for each, so a frequent term
   of a large source leaves a task as one row.
2. Kept terms: those of at least ``least_docs`` documents of a language. Each becomes a wide vector, the counts of the
   language's sources in the order of their names.
3. Shares: p = 1 + floor(scale x (count + smoothing) / (N + smoothing x V)), in whole numbers throughout.
4. Pairs: for each vector, higher-order functions give |p_a - p_b| for each source a and every later one b; these
   contributions are summed before and after the shuffle. Terms: those a source uses more than its language does.

The pairs of sources are the result, so their number grows with the square of a language's sources by definition; what
is held at once is one vector, and one source's contributions beside it.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialize, python_workers

#: Distinct (group, term) entries that a task holds before it hands them on.
MOST_HELD = 200_000
#: A count up to this times ``SCALE`` still fits a long; beyond, shares are divided as decimals.
SCALE, SAFE_COUNT = 1_000_000_000, 9_000_000_000


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs) with one row for each task that met the term there, or a few: occurrences and documents.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. In UTF-8 these are runs of bytes, and
    lower-casing bytes changes A-Z only.
    """
    import pyarrow as pa

    python_workers(docs.sparkSession)
    none = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), none).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col), none).cast("binary").alias("text"))

    def count(batches):
        import re

        runs = re.compile(rb"[a-z\x80-\xff]+").findall
        groups: dict = {}

        def told():
            for (lang, source), (n, held) in groups.items():
                terms = list(n)
                for i in range(0, len(terms), 65_536):
                    some = terms[i : i + 65_536]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([held[t] for t in some], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                found = runs(text.as_py().lower())
                n, held = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                n.update(found)
                held.update(set(found))
            if sum(len(n) for n, _ in groups.values()) > MOST_HELD:
                yield from told()
        yield from told()

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _share(count: Column, total: Column, smoothing: int) -> Column:
    """1 + floor(SCALE x (count + smoothing) / total), exactly."""
    wide = F.call_function("div", (count + smoothing).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))
    return F.when(count <= SAFE_COUNT, F.call_function("div", (count + smoothing) * F.lit(SCALE).cast("long"), total)).otherwise(wide) + 1


def term_vectors(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, smoothing: int = 5) -> tuple[DataFrame, DataFrame]:
    """(vectors, languages). vectors: (lang, term, counts: array<long> by source); languages: (lang, sources, totals, total).

    sources are all sources of the language by name, those without terms too; totals are N + smoothing x V of each, and
    total is that of the whole language.
    """
    counted = count_terms(docs, lang_col, source_col, text_col)
    # dealt by term once: both aggregates below then find their rows where they are
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("entries"))
    kept = materialize(by_term.filter(F.col("docs") >= least_docs).select("lang", "term", "entries"), "divergence-terms")

    none = F.lit("")
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), none).alias("lang"), F.coalesce(F.col(source_col).cast("string"), none).alias("source")).distinct()
    entries = kept.select("lang", F.inline("entries"))
    n_of = groups.withColumn("n", F.lit(0).cast("long")).unionByName(entries).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    v_of = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sides = n_of.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"), F.sum("n").alias("all")).join(v_of, "lang", "left")
    room = F.coalesce("v", F.lit(0).cast("long")) * smoothing
    languages = materialize(sides.select("lang", F.col("groups.source").alias("sources"), F.transform("groups", lambda g: g["n"] + room).alias("totals"), (F.col("all") + room).alias("total")), "divergence-languages")
    # languages are few rows of narrow arrays, whose written size tells Spark whether to broadcast them; else AQE splits hot ones
    wide = kept.join(languages, "lang").withColumn("of", F.map_from_entries("entries"))
    counts = F.transform("sources", lambda s: F.coalesce(F.element_at("of", s), F.lit(0).cast("long")))
    return wide.select("lang", "term", counts.alias("counts"), "sources", "totals", "total"), languages


def _ranked(rows: DataFrame, most: int | None) -> DataFrame:
    """Rows of (lang, source, item, value) with their rank in the group; of each group the first ``most`` or all."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def pair_divergence(vectors: DataFrame, languages: DataFrame, smoothing: int = 5) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language, both ways, the sum of |p_a - p_b| over its kept terms."""
    shares = F.transform(F.arrays_zip("counts", "totals"), lambda x: _share(x["counts"], x["totals"], smoothing))
    rows = vectors.select("lang", shares.alias("p")).select("lang", "p", F.posexplode("p").alias("a", "own"))
    apart = F.transform(F.expr("slice(p, a + 2, size(p))"), lambda q: F.abs(q - F.col("own")))
    given = rows.select("lang", "a", F.posexplode(apart).alias("b", "value")).select("lang", "a", (F.col("a") + F.col("b") + 1).alias("b"), "value")
    size = F.size("sources")
    none = languages.select("lang", size.alias("n"), F.explode(F.sequence(F.lit(0), size - 1)).alias("a")).filter("a + 1 < n")
    none = none.select("lang", "a", F.explode(F.sequence(F.col("a") + 1, F.col("n") - 1)).alias("b"), F.lit(0).cast("long").alias("value"))  # a language without kept terms has its pairs too
    sums = given.unionByName(none).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = sums.join(languages.select("lang", "sources"), "lang").select("lang", F.get("sources", F.col("a")).alias("x"), F.get("sources", F.col("b")).alias("y"), "value")
    both = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    return named.select("lang", both.alias("s"), "value").select("lang", "s.source", "s.item", "value")


def term_divergence(vectors: DataFrame, smoothing: int = 5) -> DataFrame:
    """(lang, source, item, value): the kept terms that a source has, and uses more than its language does, by how much."""
    whole = _share(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y), F.col("total"), smoothing)
    rows = vectors.withColumn("q", whole).select("lang", "term", "q", F.explode(F.filter(F.arrays_zip("sources", "counts", "totals"), lambda x: x["counts"] > 0)).alias("x"))
    rows = rows.withColumn("value", _share(F.col("x.counts"), F.col("x.totals"), smoothing) - F.col("q"))
    return rows.filter("value > 0").select("lang", F.col("x.sources").alias("source"), F.col("term").alias("item"), "value")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, smoothing: int = 5, top_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance to each other one (part pair), and its own terms (part term).

    Null text, lang and source count as empty. Every row is a document, repeated ones too. Equal values rank by item in
    UTF-8 order. A source without terms has its pairs; one alone in its language has none; an empty table gives an empty
    result; other columns play no part, whatever their names.
    """
    vectors, languages = term_vectors(docs, lang_col, source_col, text_col, least_docs, smoothing)
    pairs = _ranked(pair_divergence(vectors, languages, smoothing), None).withColumn("part", F.lit("pair"))
    terms = _ranked(term_divergence(vectors, smoothing), top_terms).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
