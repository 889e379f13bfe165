"""Catalog operators: shape an index and details into a catalog, pick, list, describe, rank, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.names import app_name, latest_version
from strandline.functions.text import listing_line, tool_description
from strandline.functions.types import short_type, short_types
from strandline.operators.sequences import last_wins, with_rank
from strandline.schemas import DETAIL


def shape_catalog(index: DataFrame, details: DataFrame) -> DataFrame:
    """The catalog: one row for each entry of the index, in its order, with the detail's arrays or empty ones.

    index: ord, app_url, description, latest_update, versions; details: app_name, input, output, parameters. The
    description comes from the index. A repeated name keeps its first place and its last values.
    """
    rows = index.select("ord", app_name(F.col("app_url")).alias("app_name"), latest_version(F.col("versions")).alias("latest_version"), F.coalesce("description", F.lit("")).alias("description"))
    rows = last_wins(rows, "app_name", "ord")
    both = rows.join(details.select("app_name", "input", "output", "parameters").dropDuplicates(["app_name"]), "app_name", "left")
    arrays = [F.coalesce(F.col(c), F.array().cast(DETAIL[c].dataType)).alias(c) for c in ("input", "output", "parameters")]
    return both.select("ord", "app_name", "latest_version", "description", *arrays)


def pick_app(catalog: DataFrame, name: str) -> DataFrame:
    """One app's row; empty if there is none. The filter reaches the source."""
    return catalog.filter(F.col("app_name") == name)


def planning_view(catalog: DataFrame, mode: str = "fixed") -> DataFrame:
    """What a planner sees of each tool: description, short types, parameters. The version is not carried over."""
    outputs = F.filter(F.transform("output", lambda o: short_type(o["type"], mode)), lambda t: t != "")
    return catalog.select("ord", "app_name", "description", short_types(F.col("input"), mode).alias("input_types"), outputs.alias("output_types"), "parameters", F.lit("unknown").alias("app_version"))


def tool_lines(catalog: DataFrame, mode: str = "fixed") -> DataFrame:
    view = planning_view(catalog, mode)
    return view.select("ord", "app_name", listing_line(F.col("app_name"), F.col("description"), F.col("input_types"), F.col("output_types")).alias("line"))


def describe_tools(catalog: DataFrame, kind: str = "Tool") -> DataFrame:
    about = F.when(F.col("description") != "", F.col("description"))
    return catalog.select("ord", "app_name", tool_description(about, F.col("input"), F.col("output"), F.col("parameters"), F.col("latest_version"), kind).alias("description"))


def exploded_types(catalog: DataFrame, mode: str = "fixed") -> tuple[DataFrame, DataFrame]:
    """(tool, out_ord, out_type) and (tool, ord, in_type), as the compatibility operators want them."""
    view = planning_view(catalog, mode)
    outs = view.select(F.col("app_name").alias("tool"), F.posexplode("output_types").alias("out_ord", "out_type"))
    ins = view.select(F.col("app_name").alias("tool"), "ord", F.explode("input_types").alias("in_type"))
    return outs, ins


def palette(catalog: DataFrame, name: str = "app_name", collation: str = "UNICODE", tie: str = "ord", rank: str = "rank") -> DataFrame:
    """Rows with their rank by name under a collation; equal names keep the catalog's order. A missing name sorts as an empty one."""
    order = [F.collate(F.coalesce(F.col(name), F.lit("")), collation), F.col(tie)]
    return with_rank(catalog, order, rank)


def health(**tables: DataFrame | None) -> DataFrame:
    """One row: status, for each part whether it is there (name_available) and how many rows it has (name_count, else null)."""
    there = {n: t for n, t in tables.items() if t is not None}
    out = None
    for name, t in there.items():
        one = t.agg(F.count(F.lit(1)).alias(f"{name}_count"))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    if out is None:
        raise ValueError("no part is there, so there is no session to ask")
    for name in tables:
        out = out.withColumn(f"{name}_available", F.lit(name in there))
        if name not in there:
            out = out.withColumn(f"{name}_count", F.lit(None).cast("long"))
    return out.withColumn("status", F.lit("healthy"))
