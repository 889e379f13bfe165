"""Type compatibility: which tool may follow which, next-tool suggestions, and the validity of pipeline edges.

The rule table is a parameter of the caller, whose size Spark knows when it chooses the joins. Both kinds of match, equal
types and rule pairs, are equi-joins on the input type; no nested loop over tools remains.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.types import slots_match
from strandline.operators.sequences import first_rows, ordered

#: Output type -> input types that accept it beside an equal one, in lower case.
RULES: dict[str, tuple[str, ...]] = {
    "videodocument": ("timeframe", "boundingbox"),
    "timeframe": ("alignment", "textdocument"),
    "alignment": ("textdocument",),
    "textdocument": ("namedentity", "entity"),
}
#: What to start with when there is no last tool or it is unknown.
STARTERS = ("transnet-wrapper", "whisper-wrapper", "easyocr-wrapper")


def rule_table(spark: SparkSession, rules: dict[str, Sequence[str]] = RULES) -> DataFrame:
    """(out_type, in_type), lower-case, distinct."""
    pairs = sorted({(a.lower(), b.lower()) for a, bs in rules.items() for b in bs})
    return spark.createDataFrame(pairs, "out_type string, in_type string")


def accepted_types(outputs: DataFrame, rules: DataFrame) -> DataFrame:
    """outputs (with out_type) repeated for each input type that accepts the output: its own and those of the rules."""
    low = outputs.withColumn("out_type", F.lower("out_type"))
    same = low.withColumn("in_type", F.col("out_type"))
    ruled = low.join(rules.filter("out_type <> in_type"), "out_type")
    return same.unionByName(ruled)


def compatible_pairs(outputs: DataFrame, inputs: DataFrame, rules: DataFrame, tool: str = "tool") -> DataFrame:
    """Distinct (source, target) of different tools where an output of the source fits an input of the target.

    outputs: tool, out_type; inputs: tool, in_type. Tools of the same set of types are taken together: sets are matched by type
    first, which are few, and unfolded to tools at the end, where each pair comes up once.
    """
    def sets(rows: DataFrame, name: str, kinds: str) -> DataFrame:
        return rows.groupBy(name).agg(F.array_sort(F.collect_set("in_type")).alias(kinds))  # of one tool's types

    left = sets(accepted_types(outputs.select(F.col(tool).alias("source"), "out_type"), rules).select("source", "in_type"), "source", "gives")
    right = sets(inputs.select(F.col(tool).alias("target"), F.lower("in_type").alias("in_type")), "target", "takes")
    given, taken = left.select("gives").distinct(), right.select("takes").distinct()
    fitting = given.select("gives", F.explode("gives").alias("t")).join(taken.select("takes", F.explode("takes").alias("t")), "t").select("gives", "takes").distinct()
    return left.join(fitting, "gives").join(right, "takes").filter("source <> target").select("source", "target")


def suggest_next(last: DataFrame, outputs: DataFrame, inputs: DataFrame, rules: DataFrame, k: int = 5, repeats: bool = True) -> DataFrame:
    """At most k tools that may follow each last tool: (last, rank, tool), in catalog order.

    last: last; outputs: tool, out_ord, out_type; inputs: tool, ord, in_type. With repeats a tool takes a place for each
    output type that fits, as a plain nested loop would give; without, one place. Only the first k + 1 tools of each
    input type can be among the answers (one may be the last tool itself), so the others never meet a join.
    Last tools that the catalog does not have get the starters. Tools are returned as strings.
    """
    spark = last.sparkSession
    near = inputs.select("tool", "ord", F.lower("in_type").alias("in_type")).distinct()
    near = first_rows(near, ["in_type"], ["ord", "tool"], k + 1)
    own = last.join(outputs.select(F.col("tool").alias("last"), "out_ord", "out_type"), "last")
    accepts = accepted_types(own, rules)
    hits = accepts.join(near, "in_type").filter("tool <> last")
    hits = hits.select("last", "out_ord", "ord", "tool").distinct() if repeats else hits.groupBy("last", "tool").agg(F.min("ord").alias("ord"), F.min("out_ord").alias("out_ord"))
    found = hits.withColumn("rank", F.row_number().over(ordered(["last"], ["ord", "tool", "out_ord"])).cast("long")).filter(F.col("rank") <= k).select("last", "rank", F.col("tool").cast("string").alias("tool"))
    known = outputs.select(F.col("tool").alias("last")).unionByName(inputs.select(F.col("tool").alias("last"))).distinct()
    start = spark.createDataFrame([(i + 1, t) for i, t in enumerate(STARTERS[:k])], "rank long, tool string")
    unknown = last.join(known, "last", "left_anti").crossJoin(F.broadcast(start)).select("last", "rank", "tool")
    return found.unionByName(unknown)


def valid_connections(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """edges with ``edge_type``: 'default' if an output of the source shares a namespace with an input of the target, else 'invalid'.

    edges: source_tool, target_tool, ...; edges whose endpoint the catalog lacks are dropped.
    """
    source = catalog.select(F.col("app_name").alias("source_tool"), F.col("output").alias("_output"))
    target = catalog.select(F.col("app_name").alias("target_tool"), F.col("input").alias("_input"))
    both = edges.join(source, "source_tool").join(target, "target_tool")
    return both.withColumn("edge_type", F.when(slots_match(F.col("_output"), F.col("_input")), "default").otherwise("invalid")).drop("_output", "_input")


def typed_edges(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """edges (source_type, target_type, ...) with ``edge_type`` by equality or the rule table."""
    pairs = rules.select(F.col("out_type").alias("_o"), F.col("in_type").alias("_i"), F.lit(True).alias("_ruled"))
    joined = edges.join(pairs, (F.lower("source_type") == F.col("_o")) & (F.lower("target_type") == F.col("_i")), "left")
    fits = (F.lower("source_type") == F.lower("target_type")) | F.coalesce(F.col("_ruled"), F.lit(False))
    return joined.withColumn("edge_type", F.when(fits, "default").otherwise("invalid")).drop("_o", "_i", "_ruled")
