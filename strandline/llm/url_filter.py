"""URL filters: explicit rules first, then a path-template tree per host learned from labelled urls.

1. A path is cut into segments; segments that vary by form (numbers, hashes, mixed) become wildcards of their kind.
2. Level by level, the labelled branches of a node are merged where their shares of blocked urls do not differ
   significantly: in the order of their shares each is held against the pooled run of those before it, not just against
   the last one, so a slow drift ends a run. Branches whose shares fall into one of ``bins`` intervals are pooled first.
3. Branches without any label inherit the node's share; those with less than 1/max_children of its urls become one
   wildcard. Nothing is learned below them, so the tree goes no further there.
4. Each node's share of blocked urls is smoothed towards its parent's, the host's and the whole table's. A url whose
   deepest node is blocked by more than the allowed share is rejected.

Counts are summed per distinct generalised path before anything else is shuffled, so a hot host is a few rows; a node's
branches are summed per interval before they meet in one row, which so has at most bins + 1 entries. A level is one
written table; where a labelled path goes on alone, its rest is walked at once, so there are as many levels as
labelled paths stay together in a branch, whatever their length. Rows take their template by path: paths that hold more
than 1/``HOT_PATHS`` of all rows are broadcast, and their rows dealt over ``SALTS`` parts of the join of the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import ascii_lower, materialize

#: Fixed values: (verdict, host and path). A rule fits the host and its subdomains if the path starts with the rule's.
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: A path is hot with more than this part of all rows, so at most that many are; one of more letters is joined like the others.
HOT_PATHS, HOT_LETTERS, SALTS = 1024, 8192, 64


@dataclass(frozen=True)
class TreeOptions:
    """bins: intervals of shares. smoothing: urls that a parent's share weighs. z: a merge needs a difference below so many
    standard errors. worst: more blocked urls than this share reject a template."""

    bins: int = 200
    max_children: int = 20
    smoothing: float = 4.0
    z: float = 1.96
    worst: float = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ://; both empty for null and for urls without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The segments of a path in general form."""
    def general(s: Column) -> Column:
        stem, end = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})?$", 0)
        kind = (
            F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}"))
            .when(stem.rlike(r"^[0-9a-fA-F]{8,}$") | stem.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit("{hex}"))
            .when(stem.rlike(r"[0-9]"), F.lit("{x}"))
        )
        return F.when(kind.isNotNull(), F.concat(kind, end)).otherwise(s)

    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), general)


def _runs(bins: Column, z: float) -> Column:
    """array<struct<bin, run>> for an array of struct<bin, l, b> sorted by bin: each is held against the pooled run before it."""
    none = F.array().cast("array<struct<bin:bigint,run:int>>")
    start = F.struct(F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("b"), F.lit(-1).alias("run"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        l, b, l0, b0 = x["l"].cast("double"), x["b"].cast("double"), acc["l"].cast("double"), acc["b"].cast("double")
        pooled = (b + b0 + 1.0) / (l + l0 + 2.0)
        error = F.sqrt(pooled * (1.0 - pooled) * (1.0 / l + F.try_divide(F.lit(1.0), l0)))
        apart = F.coalesce(F.abs(b / l - F.try_divide(b0, l0)) > F.lit(z) * error, F.lit(True))
        run = F.when(apart, acc["run"] + 1).otherwise(acc["run"])
        return F.struct(
            F.when(apart, x["l"]).otherwise(acc["l"] + x["l"]).alias("l"),
            F.when(apart, x["b"]).otherwise(acc["b"] + x["b"]).alias("b"),
            run.alias("run"),
            F.array_append(acc["out"], F.struct(x["bin"].alias("bin"), run.alias("run"))).alias("out"),
        )

    return F.aggregate(bins, start, step)["out"]


def _level(at: DataFrame, level: int, options: TreeOptions) -> DataFrame:
    """at: (host, segs, n, labelled, blocked, node, share, open). The open paths that go on at this level get the next
    node, or where a labelled one is alone in it, the last node of its path."""
    m = F.lit(float(options.smoothing))
    goes_on = F.col("open") & (F.size("segs") > level)
    deeper = at.filter(goes_on).withColumn("seg", F.get("segs", F.lit(level)))
    key = ["host", "node"]
    children = deeper.groupBy(*key, "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.max("share").alias("parent"), F.count(F.lit(1)).alias("paths"))
    in_bin = F.expr(f"b * {int(options.bins)} div l")
    known = children.filter("l > 0").withColumn("bin", in_bin)
    bins = known.groupBy(*key, "bin").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.min("seg").alias("first"), F.count(F.lit(1)).alias("many"), F.max("parent").alias("parent"), F.sum("paths").alias("paths"))
    runs = bins.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("bin", "l", "b"))).alias("bins")).select(*key, F.inline(_runs(F.col("bins"), options.z)))
    of_bin = bins.join(runs, [*key, "bin"])
    merged = of_bin.groupBy(*key, "run").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.min("first").alias("first"), F.sum("many").alias("many"), F.max("parent").alias("parent"), F.sum("paths").alias("paths"))
    # a name tells the first of the merged branches and how many follow
    name = F.when(F.col("many") > 1, F.concat("first", F.lit("|+"), (F.col("many") - 1).cast("string"))).otherwise(F.col("first"))
    merged = merged.select(*key, "run", name.alias("name"), ((F.col("b") + m * F.col("parent")) / (F.col("l") + m)).alias("share_here"), (F.col("paths") == 1).alias("alone"))
    learned = known.select(*key, "seg", "bin").join(runs, [*key, "bin"]).join(merged, [*key, "run"]).select(*key, "seg", "name", "share_here", F.lit(True).alias("labelled_here"), "alone")
    totals = children.groupBy(*key).agg(F.sum("n").alias("of"))
    rare = ~F.startswith(F.col("seg"), F.lit("{")) & (F.col("n") * options.max_children < F.col("of"))
    others = children.filter("l = 0").join(totals, key).select(*key, "seg", F.when(rare, F.lit("*")).otherwise(F.col("seg")).alias("name"), F.col("parent").alias("share_here"), F.lit(False).alias("labelled_here"), F.lit(False).alias("alone"))
    moved = deeper.join(learned.unionByName(others), [*key, "seg"])
    # nothing branches off below a path that is alone: each of its segments is a node of the path's own counts
    left = F.when(F.col("alone"), F.slice("segs", level + 2, F.greatest(F.size("segs") - level - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    share = F.aggregate(left, F.col("share_here"), lambda above, _: (F.col("blocked") + m * above) / (F.col("labelled") + m))
    node = F.array_join(F.concat(F.array("node", "name"), left), "/")
    moved = moved.select("host", "segs", "n", "labelled", "blocked", node.alias("node"), share.alias("share"), (F.col("labelled_here") & ~F.col("alone")).alias("open"))
    return moved.unionByName(at.filter(~goes_on).withColumn("open", F.lit(False)))


def learn_templates(counts: DataFrame, options: TreeOptions = TreeOptions()) -> DataFrame:
    """(host, segs, n, template, blocked_share) for counts of (host, segs, n, labelled, blocked), distinct by host and segs.

    template: the path's deepest node; blocked_share: the smoothed share there. Hosts without labels have the whole
    table's share; without any label that is one half.
    """
    m = F.lit(float(options.smoothing))
    total = counts.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.max(F.size("segs")), F.lit(0)).alias("longest")).first()
    root = (total["b"] + 1.0) / (total["l"] + 2.0)
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    hosts = hosts.select("host", ((F.col("b") + m * F.lit(root)) / (F.col("l") + m)).alias("share"), (F.col("l") > 0).alias("open"))
    at = counts.join(hosts, "host").select("host", "segs", "n", "labelled", "blocked", F.lit("").alias("node"), "share", "open")
    level, more = 0, total["l"] > 0 and total["longest"] > 0
    while more:
        at = materialize(_level(at, level, options), f"url-level-{level + 1}")
        level += 1
        more = not at.filter(F.col("open") & (F.size("segs") > level)).isEmpty()
    return at.select("host", "segs", "n", F.when(F.col("node") == "", F.lit("/")).otherwise(F.col("node")).alias("template"), F.col("share").alias("blocked_share"))


def _with_templates(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """rows (id, host, segs, ...) with the template and blocked_share of their path, in one pass and without a hot task."""
    total = learned.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    letters = F.char_length("host") + F.char_length(F.array_join("segs", "/")) + F.char_length("template")
    is_hot = (F.col("n") * HOT_PATHS > F.lit(total)) & (letters <= HOT_LETTERS)
    hot = learned.filter(is_hot).select("host", "segs", F.struct("template", "blocked_share").alias("hot"))
    cold = learned.filter(~is_hot).select("host", "segs", F.lit(-1).cast("long").alias("salt"), F.struct("template", "blocked_share").alias("cold"))
    dealt = rows.join(F.broadcast(hot), ["host", "segs"], "left")
    # rows that have their template find nothing in the second join, wherever they are sent
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(-1).cast("long"))
    both = dealt.withColumn("salt", salt).join(cold, ["host", "segs", "salt"], "left").withColumn("of", F.coalesce("hot", "cold"))
    return both.drop("hot", "cold", "salt").withColumns({"template": F.col("of.template"), "blocked_share": F.col("of.blocked_share")}).drop("of")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, options: TreeOptions = TreeOptions(), label_col: str | None = None) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict, template, blocked_share.

    The verdict is the longest fitting rule's; where none fits, block if the template's smoothed blocked share is above
    ``options.worst``, else allow. Labels are the verdicts of rules, or with label_col that column's values: block,
    allow or null for unlabelled. Null urls and urls without :// have an empty host and path. Repeated rows count as
    often as they stand and stay repeated; null ids stay null; an empty table gives an empty result; other columns play
    no part. An id column with the name of a result column is refused.
    """
    if id_col.lower() in (results := ("host", "path", "rule", "verdict", "template", "blocked_share")):
        raise ValueError(f"{id_col} is a column of the result, as are {', '.join(results)}")
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), label.alias("label"))
    host, path = split_url(F.col("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"), "label")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "label", segments(F.col("path")).alias("segs"))
    known = F.col("label") if label_col else F.col("ruled")
    counts = rows.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.sum(known.isNotNull().cast("long")).alias("labelled"), F.sum(F.coalesce((known == "block").cast("long"), F.lit(0))).alias("blocked"))
    learned = learn_templates(materialize(counts, "url-counts"), options)
    judged = _with_templates(rows, learned)
    method = F.when(F.col("blocked_share") > options.worst, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "blocked_share")
