"""Interchange documents (opaque JSON strings) and wire frames."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import sse_frame


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, body) of whole files, in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("body"))


def path_or_text(spark: SparkSession, value: str) -> str:
    """The content of a file, if the value names one, else the value."""
    if len(value) < 4096 and "\n" not in value and os.path.exists(value):
        return spark.read.text(value, wholetext=True).first()["value"]
    return value


def first_sample(spark: SparkSession, folders: list[str], pattern: str) -> str | None:
    """The first file that matches in the first folder that has one."""
    for folder in folders:
        if os.path.isdir(folder):
            found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").orderBy("path").first()
            if found:
                return found["path"]
    return None


def document_parts(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row for each document listed in a body: (path, type, mime, id, location); bodies that do not parse have none."""
    kind = "struct<documents:array<struct<`@type`:string,properties:struct<mime:string,id:string,location:string>>>>"
    rows = bodies.withColumn("_d", F.explode(F.from_json(body, kind)["documents"]))
    return rows.select("path", F.col("_d").getField("@type").alias("type"), "_d.properties.mime", "_d.properties.id", "_d.properties.location")


def sse_frames(events: DataFrame) -> Column:
    """Frames of rows (type, data, timestamp, session_id), with real line breaks, error frames too."""
    return sse_frame(F.to_json(F.struct("type", "data", "timestamp", "session_id")))


def write_frames(events: DataFrame, path: str) -> None:
    """A sink of frames; each row ends with one line break, the frame's second one."""
    frame = sse_frames(events)
    events.select(F.substring(frame, F.lit(1), F.char_length(frame) - 1).alias("value")).write.mode("append").text(path)
