"""PII: patterns for known kinds, and an information-theoretic test for terms that give a person away. DataFrame operations only.

Entities are the matches of the patterns; a term is any other word of ``LEAST_LETTERS`` code points or more. Of a term's n_t
occurrences in the corpus, n_ct stand beside an entity c, that is begin and end within ``WINDOW`` code points of it; of the
d_t documents that hold the term, d_ct have it beside c. c is the entity that the term stands beside in most documents. The
information of c is -log p(c), the term's pointwise mutual information with it log p(c|t) - log p(c); what is left of the
one after the other, -log p(c|t), is how uncertain c stays for a reader of the term. p(c|t) is estimated by the lower end
of its confidence interval (Wilson's, ``z`` standard errors), by occurrences and by documents, and the smaller of the two
counts: a word that stands once, or in one document only, tells nothing yet. A term that leaves at most ``generalise_bits`` of
an entity discloses it and is generalised; at most ``remove_bits``, and it is removed. Both happen wherever the term
stands, in texts without entities too.

Terms are generalised along their beginnings, of 6, 4 and 2 code points: to the longest one whose own terms, all together,
do not disclose any entity by the same test on occurrences; where there is none, to a word for its form.

Positions are counted in blocks of ``BLOCK`` code points, so that texts with many entities are cut in linear time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fresh, materialize

KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns. They match what the plain forms match; possessive quantifiers and the look-behind only
#: keep long runs of one class from being tried from each of their characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no valid match of the kind; they are cheap to look for.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: What stands for an entity, and for a term that has no beginning to be generalised to, by its form.
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
FORMS = {"number": "<NUMBER>", "code": "<CODE>", "name": "<NAME>", "word": "<WORD>"}
WORD, NO_WORD = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
WINDOW, LEAST_LETTERS, BLOCK = 100, 3, 1024
#: Code points of the beginnings that a term may be generalised to, the longest first.
BEGINNINGS = (6, 4, 2)


@dataclass(frozen=True)
class Disclosure:
    """z: how many standard errors the bound of a share lies below it; with 1.2816 one in ten true shares is smaller. The bits of an
    entity that a term may leave at most to be generalised or removed."""

    z: float = 1.2816
    generalise_bits: float = 1.0
    remove_bits: float = 0.25


def least_share(hits: Column, of: Column, z: float) -> Column:
    """The lower end of Wilson's interval of the share that hits of some are."""
    h, n, zz = hits.cast("double"), of.cast("double"), F.lit(z * z)
    p = h / n
    return (p + zz / (F.lit(2.0) * n) - F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + zz / (F.lit(4.0) * n * n))) / (F.lit(1.0) + zz / n)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used: lambdas keep their arguments, other expressions are made anew."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """What join makes of zero and all values before each one, as array<long>; blockwise, so that long arrays are not copied for each element."""
    def before(xs: Column, start: Column) -> Column:
        seed = F.struct(start.alias("total"), F.array().cast("array<long>").alias("list"))
        return F.aggregate(xs, seed, lambda acc, x: F.struct(join(acc["total"], x).alias("total"), F.array_append(acc["list"], acc["total"]).alias("list")))["list"]

    zero = F.lit(0).cast("long")

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / block).cast("int") - 1, F.lit(0))), lambda b: F.slice(xs, b * block + 1, block))

    def of_blocks(parts: Column) -> Column:
        return F.flatten(F.zip_with(parts, before(F.transform(parts, lambda xs: F.aggregate(xs, zero, join)), zero), before))

    return _once(values, lambda xs: _once(blocks(xs), of_blocks))


def running_sums(values: Column) -> Column:
    return _running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return _running(values, lambda a, b: F.greatest(a, b))


def _blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points; the last one is shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text from start to end (code points, end exclusive) of its blocks; empty where end is not after start."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substr(some, (start % BLOCK).cast("int") + 1, (end - start).cast("int"))).otherwise(F.lit(""))


def _replaced(text: Column, spans: Column, sign: Callable[[Column], Column]) -> Column:
    """The text with spans (array of struct<start, end, ...>, not empty) replaced by their signs. Of spans that overlap each other
    the first one's sign stands for all, though what the later ones add is dropped as well."""
    def of(both: Column, blocks: Column) -> Column:
        fresh_ones = F.filter(both, lambda b: b["s"]["start"] >= b["r"])
        last = F.array_max(F.transform(both, lambda b: b["s"]["end"]))
        return F.concat(F.array_join(F.transform(fresh_ones, lambda b: F.concat(_cut(blocks, b["r"], b["s"]["start"]), sign(b["s"]))), ""), _cut(blocks, last, F.char_length(text).cast("long")))

    return _once(_reached(spans), lambda both: _once(_blocks(text), lambda blocks: of(both, blocks)))


def _reached(spans: Column) -> Column:
    """array<struct<s: span, r: how far the spans before it reach>>, sorted."""
    return _once(F.array_sort(spans), lambda xs: F.zip_with(xs, running_max(F.transform(xs, lambda s: s["end"])), lambda s, r: F.struct(s.alias("s"), r.alias("r"))))


def matches(text: Column, pattern: str) -> Column:
    """The leftmost matches that do not overlap, as array<struct<start, end, value>>; code points, end exclusive."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def measured(p: Column) -> Column:
        return F.zip_with(p["found"], F.slice(p["gaps"], 1, F.size(p["found"])), lambda v, g: F.struct(F.char_length(g).cast("long").alias("gap"), F.char_length(v).cast("long").alias("own"), v.alias("value")))

    def placed(both: Column) -> Column:
        ahead = running_sums(F.transform(both, lambda m: m["gap"] + m["own"]))
        return F.zip_with(both, ahead, lambda m, a: F.struct((a + m["gap"]).alias("start"), (a + m["gap"] + m["own"]).alias("end"), m["value"].alias("value")))

    return _once(parts, lambda p: _once(measured(p), placed))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))

    def digit(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(back)), F.lit(0), lambda acc, i: acc + digit(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int") <= 255))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind (its place in KINDS), start, end, value>> by kind, then start, of a text that is not null."""
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,value:string>>")

    def of(place: int, kind: str) -> Column:
        own = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        own = F.transform(own, lambda m: F.struct(F.lit(place).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(text.rlike(HINTS[kind]), own).otherwise(empty)

    return F.concat(*[of(place, kind) for place, kind in enumerate(KINDS[:4])])


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: Column, base: Column) -> Column:
    """The text with blanks for its entities: what stands elsewhere keeps its place, and no word lies in an entity."""
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    # what a span adds to those before it, so that overlapping spans are blanked in all their length
    apart = F.transform(_reached(plain), lambda b: F.struct(F.greatest(b["s"]["start"], b["r"]).alias("start"), F.greatest(b["s"]["end"], b["r"]).alias("end")))
    blanked = _replaced(text, F.filter(apart, lambda s: s["end"] > s["start"]), lambda s: F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")))
    return F.when(F.size(base) > 0, blanked).otherwise(text)


def _words() -> Column:
    """The words of a masked text, lower-cased, with repeats; null for a null text."""
    return F.filter(F.split(F.lower("masked"), NO_WORD, -1), lambda w: F.char_length(w) >= LEAST_LETTERS)


def _placed(text: Column, start: Column) -> Column:
    """array<struct<start, end, term>> of the words of a text that begins at start."""
    return F.transform(matches(text, WORD), lambda m: F.struct((m["start"] + start).alias("start"), (m["end"] + start).alias("end"), m["value"].alias("value")))


def _beside(blocks: Column, length: Column, span: Column) -> Column:
    """The words that begin and end within WINDOW of a span, of a masked text in blocks."""
    start, end = span["start"], span["end"]
    left = _cut(blocks, F.greatest(start - WINDOW - 1, F.lit(0).cast("long")), start)  # one more on each side tells whether a word is cut
    left = F.when(start > WINDOW, F.regexp_replace(left, "^" + WORD, "")).otherwise(left)
    right = _cut(blocks, end, F.least(end + WINDOW + 1, length))
    right = F.when(length - end > WINDOW, F.regexp_replace(right, WORD + "$", "")).otherwise(right)
    return F.concat(_placed(left, start - F.char_length(left)), _placed(right, end))


def _scanned(docs: DataFrame, text_col: str, *others: Column) -> tuple[DataFrame, str, str, str]:
    """The others of each row of docs with a row number, the masked text and the entities, written once; and the names of these three."""
    rows = docs.select(*others, F.col(text_col).alias("scanned text"))
    number, masked, base = fresh(rows, "number", "masked", "base")
    text = F.coalesce(F.col("scanned text"), F.lit(""))
    rows = rows.withColumn(base, base_spans(text))
    rows = rows.withColumn(masked, _masked(F.col("scanned text"), F.col(base))).drop("scanned text").withColumn(number, F.monotonically_increasing_id())
    return materialize(rows, "pii-rows"), number, masked, base


def _counts(rows: DataFrame) -> DataFrame:
    """(term, n_t, d_t): how often each term occurs, and in how many rows. Each text tells its different words apart by itself."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def told(words: Column) -> Column:
        every = F.transform(words, lambda w: F.struct(w.alias("term"), one.alias("n"), none.alias("d")))
        once = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("term"), none.alias("n"), one.alias("d")))
        return F.concat(every, once)

    return rows.select(F.inline(_once(_words(), told))).groupBy("term").agg(F.sum("n").alias("n_t"), F.sum("d").alias("d_t"))


def _beginnings() -> Column:
    """array<string> of a term's beginnings, itself if it is one."""
    return F.filter(F.array(*[F.when(F.char_length("term") >= n, F.left("term", F.lit(n))) for n in BEGINNINGS]), lambda b: b.isNotNull())


def _near(rows: DataFrame) -> DataFrame:
    """(kind, value, term, n_ct, d_ct): how often, and in how many rows, each term stands beside each entity."""
    held = rows.filter(F.size("base") > 0).select("number", "base", F.array(_blocks(F.col("masked"))).alias("blocks"), F.char_length("masked").cast("long").alias("length"))
    around = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("value"), _beside(F.element_at("blocks", 1), F.col("length"), s).alias("words")))
    near = held.select("number", F.explode(around).alias("s")).select("number", "s.kind", "s.value", F.explode("s.words").alias("w"))
    near = near.select("number", "kind", "value", F.lower("w.value").alias("term"), F.col("w.start").alias("start")).filter(F.char_length("term") >= LEAST_LETTERS)
    # dealt by row: an occurrence that is near an entity twice is counted once, and so is its row
    in_rows = near.repartition("number").distinct().groupBy("number", "kind", "value", "term").agg(F.count(F.lit(1)).alias("n"))
    return in_rows.groupBy("kind", "value", "term").agg(F.sum("n").alias("n_ct"), F.count(F.lit(1)).alias("d_ct"))


def disclosing_terms(rows: DataFrame, options: Disclosure = Disclosure()) -> DataFrame:
    """(term, mark) of the terms that disclose an entity, for rows of (number, masked, base); mark is what stands for the term:
    nothing for one to be removed, a beginning, or null for a word for its form.

    Terms are counted before they are joined, and of each only one entity is kept, so every join has one row for a
    term on either side.
    """
    pairs = materialize(_near(rows), "pii-near")
    most = pairs.groupBy("term").agg(F.max(F.struct("d_ct", "n_ct")).alias("c"))
    counts = materialize(_counts(rows), "pii-counts")
    told = most.join(counts, "term")
    share = F.least(least_share(F.col("c.n_ct"), F.col("n_t"), options.z), least_share(F.col("c.d_ct"), F.col("d_t"), options.z))
    told = materialize(told.filter(share >= 2.0**-options.generalise_bits).select("term", (share >= 2.0**-options.remove_bits).alias("gone")), "pii-told")

    wider = told.filter("NOT gone").select(F.explode(_beginnings()).alias("beginning")).distinct()
    in_all = counts.select(F.explode(_beginnings()).alias("beginning"), "n_t").join(wider, "beginning", "left_semi").groupBy("beginning").agg(F.sum("n_t").alias("n"))
    beside = pairs.select("kind", "value", F.explode(_beginnings()).alias("beginning"), "n_ct").join(wider, "beginning", "left_semi")
    beside = beside.groupBy("kind", "value", "beginning").agg(F.sum("n_ct").alias("n_c")).groupBy("beginning").agg(F.max("n_c").alias("n_c"))
    safe = in_all.join(beside, "beginning").filter(least_share(F.col("n_c"), F.col("n"), options.z) < 2.0**-options.generalise_bits).select("beginning")
    shorter = told.filter("NOT gone").select("term", F.explode(_beginnings()).alias("beginning")).filter(F.col("beginning") != F.col("term"))
    longest = shorter.join(safe, "beginning").groupBy("term").agg(F.max_by("beginning", F.char_length("beginning")).alias("beginning"))
    mark = F.when(F.col("gone"), F.lit("")).otherwise(F.concat(F.lit("<"), "beginning", F.lit("*>")))
    return materialize(told.join(longest, "term", "left").select("term", mark.alias("mark")), "pii-terms")


def _form(word: Column) -> Column:
    """What a generalised term is replaced by: a number, a code of letters and digits, a name, another word."""
    return F.when(word.rlike(r"^\p{N}+$"), FORMS["number"]).when(word.rlike(r"\p{N}"), FORMS["code"]).when(word.rlike(r"^\p{Lu}"), FORMS["name"]).otherwise(FORMS["word"])


def _term_spans(rows: DataFrame, disclosed: DataFrame) -> DataFrame:
    """(number, terms: array<struct<start, end, sign>> by start) of the rows that hold a disclosed term, wherever it stands."""
    texts = rows.select("number", F.coalesce("masked", F.lit("")).alias("masked"))
    # each text's different words; a disclosing term occurs at most 2^bits times as often as beside its entity
    own = materialize(texts.select("number", F.explode(F.array_distinct(_words())).alias("term")).join(disclosed, "term"), "pii-hits")
    held = texts.join(own.select("number").distinct(), "number", "left_semi")
    placed = held.select("number", F.explode(_placed(F.col("masked"), F.lit(0).cast("long"))).alias("w")).withColumn("term", F.lower("w.value"))
    placed = placed.join(own, ["number", "term"])
    span = F.struct(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.coalesce("mark", _form(F.col("w.value"))).alias("sign"))
    return materialize(placed.groupBy("number").agg(F.array_sort(F.collect_list(span)).alias("terms")), "pii-spans")


def _found(docs: DataFrame, text_col: str, options: Disclosure, *others: Column) -> tuple[DataFrame, str, str, str, str]:
    """The others of each row of docs with masked text, base and terms (never null), and the names of these and of the row number."""
    rows, number, masked, base = _scanned(docs, text_col, *others)
    plain = rows.select(F.col(number).alias("number"), F.col(masked).alias("masked"), F.col(base).alias("base"))
    terms = _term_spans(plain, disclosing_terms(plain, options))
    found, other = fresh(rows, "terms", "other number")
    rows = rows.join(terms.select(F.col("number").alias(other), F.col("terms").alias(found)), F.col(number) == F.col(other), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,sign:string>>")
    return rows.withColumn(found, F.coalesce(found, none)), number, masked, base, found


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Disclosure = Disclosure()) -> DataFrame:
    """One row for each row of docs: id, n_email, n_ip, n_card, n_phone, base_sha256, n_term, spans.

    spans: 'kind:start:end' of all spans, comma-joined, by kind as in KINDS, then start; base_sha256 is the digest of
    those of the patterns alone. A text's spans of one kind do not overlap; a term never overlaps a span of a pattern.
    Null texts count as empty and have no spans. Repeated rows count as often as they stand; null ids stay null; an
    empty table gives an empty result; other columns play no part.
    """
    rows, _, _, base, found = _found(docs, text_col, options, F.col(id_col).alias("id"))

    def count(place: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == place)).cast("long")

    plain = F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    terms = F.transform(found, lambda s: F.struct(F.lit(4).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(
        F.col("id").alias(id_col),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(_named(plain), 256).alias("base_sha256"),
        F.size(found).cast("long").alias("n_term"),
        _named(F.concat(plain, terms)).alias("spans"),
    )


def sanitise(docs: DataFrame, text_col: str = "text", length_col: str | None = None, options: Disclosure = Disclosure()) -> DataFrame:
    """docs with every span of a pattern replaced by its kind's placeholder, and disclosing terms generalised or removed.

    Overlapping spans are replaced as one, by the first one's placeholder. Texts without spans, null texts among them,
    stay as they are, and so do all other columns, but for length_col, which follows a text that changes.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows, _, masked, base, found = _found(docs, text_col, options, *others)
    signs = F.array(*[F.lit(PLACEHOLDERS[k]) for k in KINDS[:4]])
    of_base = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(signs, s["kind"]).alias("sign")))
    spans = F.concat(of_base, F.col(found))
    changed = F.size(spans) > 0
    rows = rows.withColumn(text_col, F.when(changed, _replaced(F.col(masked), spans, lambda s: s["sign"])).otherwise(F.col(masked)))
    if length_col:
        rows = rows.withColumn(length_col, F.when(changed, F.char_length(F.col(text_col)).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
