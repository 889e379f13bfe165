"""Pipeline graphs as rows: nodes numbered within their pipeline, edges inserted once, round trips to structs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.sequences import clear, collect_in_order, insert_if_absent, with_ordinal


def add_nodes(tools: DataFrame, keys: list[str], order: list) -> DataFrame:
    """tools (keys, tool_id, ...) with ord from 0, id '{tool_id}-{ord}' over all tools of the pipeline, and the default place."""
    rows = with_ordinal(tools, keys, order, "ord", 0)
    rows = rows.withColumn("id", F.concat("tool_id", F.lit("-"), F.col("ord").cast("string")))
    return rows.withColumn("x", F.lit(100.0)).withColumn("y", (F.col("ord") * 100).cast("double"))


def add_edges(edges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """edges (keys, source, target, order, ...) without later repeats, with id '{source}-{target}'."""
    first = insert_if_absent(edges, [*keys, "source", "target"], order)
    return first.withColumn("id", F.concat("source", F.lit("-"), "target"))


def clear_pipelines(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes or edges without those of the named pipelines."""
    return clear(rows, names.select("pipeline"), ["pipeline"])


def to_struct(names: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each pipeline: name, nodes, edges, in their order. A pipeline is collected into its own row."""
    n = nodes.groupBy(F.col("pipeline").alias("name")).agg(F.transform(collect_in_order("ord", "id", "tool_id", "data", "x", "y"), lambda s: F.struct(*[s[c].alias(c) for c in ("id", "tool_id", "data", "x", "y")])).alias("nodes"))
    e = edges.groupBy(F.col("pipeline").alias("name")).agg(F.transform(collect_in_order("ord", "id", "source", "target"), lambda s: F.struct(*[s[c].alias(c) for c in ("id", "source", "target")])).alias("edges"))
    both = names.select(F.col("pipeline").alias("name")).join(n, "name", "left").join(e, "name", "left")
    return both.select("name", F.coalesce("nodes", F.array().cast("array<struct<id:string,tool_id:string,data:string,x:double,y:double>>")).alias("nodes"), F.coalesce("edges", F.array().cast("array<struct<id:string,source:string,target:string>>")).alias("edges"))


def from_struct(pipelines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, nodes, edges) of to_struct()'s rows; a missing name becomes 'Imported Pipeline'."""
    named = pipelines.withColumn("pipeline", F.coalesce("name", F.lit("Imported Pipeline")))
    nodes = named.select("pipeline", F.posexplode("nodes").alias("_i", "n")).select("pipeline", F.col("_i").cast("long").alias("ord"), "n.*")
    edges = named.select("pipeline", F.posexplode("edges").alias("_i", "e")).select("pipeline", F.col("_i").cast("long").alias("ord"), "e.*")
    return named.select("pipeline"), nodes, edges


def from_tool_events(events: DataFrame) -> DataFrame:
    """The nodes of the pipelines that conversations build: one for each selected tool, in order.

    events: session_id, ord, type, tool_name; pipelines are named 'Pipeline-{session_id}'. Empty names add nothing.
    """
    picked = events.filter((F.col("type") == "tool_selected") & (F.coalesce("tool_name", F.lit("")) != ""))
    picked = picked.select(F.concat(F.lit("Pipeline-"), "session_id").alias("pipeline"), F.col("tool_name").alias("tool_id"), F.col("ord").alias("event_ord"))
    return add_nodes(picked, ["pipeline"], ["event_ord"]).drop("event_ord")


def displayed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with source_tool and target_tool; an edge whose endpoint is no node is dropped."""
    ends = nodes.select("pipeline", F.col("id"), F.col("tool_id"))
    s = ends.select("pipeline", F.col("id").alias("source"), F.col("tool_id").alias("source_tool"))
    t = ends.select("pipeline", F.col("id").alias("target"), F.col("tool_id").alias("target_tool"))
    return edges.join(s, ["pipeline", "source"]).join(t, ["pipeline", "target"])
