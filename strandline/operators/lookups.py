"""Lookups: keyed joins whose missing side is an answer of its own, and joins over choices by priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], found: str = "found") -> DataFrame:
    """Left join that says whether the key was there. The table has one row per key; its size decides the join (AQE)."""
    return df.join(table.withColumn(found, F.lit(True)), list(on), "left").withColumn(found, F.coalesce(found, F.lit(False)))


def latest_connection(events: DataFrame, connections: DataFrame) -> DataFrame:
    """Events with the queue of their session: a later connection replaces an earlier one; events before it are lost.

    events: session_id, at, ...; connections: session_id, connected_at, queue.
    """
    last = connections.groupBy("session_id").agg(F.max_by("queue", "connected_at").alias("queue"), F.max("connected_at").alias("connected_at"))
    return events.join(last, "session_id").filter(F.col("at") >= F.col("connected_at")).drop("connected_at")


def broadcast_events(events: DataFrame, sessions: DataFrame, most_sessions: int = 10_000) -> DataFrame:
    """Every event for every session, by definition of the operator. The sessions are counted first; more than ``most_sessions`` are
    not broadcast, and the events meet them block by block instead."""
    known = sessions.select("session_id").distinct()
    small = known.count() <= most_sessions
    return events.drop("session_id").crossJoin(F.broadcast(known) if small else known)


#: Where a tool's directory may be, by priority; {name} is its name, {stem} the name without '-wrapper'.
DIRECTORY_PATTERNS = ("app-{name}", "app-{name}-wrapper", "app-{stem}", "{name}")


def find_directories(tools: DataFrame, directories: DataFrame, patterns: Sequence[str] = DIRECTORY_PATTERNS) -> DataFrame:
    """tools with ``path``: the first pattern that names a directory that has an app.py, else null.

    tools: tool_name; directories: directory, path, has_app.
    """
    stem = F.replace("tool_name", F.lit("-wrapper"), F.lit(""))
    names = F.array(*[F.struct(F.lit(i).alias("prio"), F.replace(F.replace(F.lit(p), F.lit("{name}"), F.col("tool_name")), F.lit("{stem}"), stem).alias("directory")) for i, p in enumerate(patterns)])
    tried = tools.select("tool_name", F.explode(names).alias("t")).select("tool_name", "t.prio", "t.directory")
    hits = tried.join(directories.filter("has_app"), "directory").groupBy("tool_name").agg(F.min_by("path", "prio").alias("path"))
    return tools.join(hits, "tool_name", "left")


def session_pipeline(sessions: DataFrame, pipelines: DataFrame, asked: DataFrame) -> DataFrame:
    """session_id, pipeline, status for asked session ids: found, 'no session' or 'no pipeline'."""
    both = asked.select("session_id").join(sessions.select("session_id", F.lit(True).alias("_known")), "session_id", "left").join(pipelines.select("session_id", "pipeline"), "session_id", "left")
    status = F.when(F.col("_known").isNull(), "no session").when(F.col("pipeline").isNull(), "no pipeline").otherwise("found")
    return both.select("session_id", "pipeline", status.alias("status"))


def wanted_and_available(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """The rows of wanted (app_name, ...) whose app the catalog has."""
    return wanted.join(catalog.select("app_name").distinct(), "app_name", "left_semi")
