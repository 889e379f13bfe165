"""Event logs: 'time - level - [session] TYPE: pretty JSON' records over several lines; writing, reading, following."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record begins where a line begins with a time.
HEADER = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - (\w+) - \[([^\]]*)\] (\w+): ([\s\S]*)$"
SPLIT = r"\n(?=\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} - )"


def parse_log(files: DataFrame, text: str = "value") -> DataFrame:
    """(ord, log_ts, level, session_id, log_type, body) of whole log files; records that are no events have a null type."""
    rows = files.select(F.posexplode(F.split(F.rtrim(text, F.lit("\n")), SPLIT)).alias("ord", "r")).filter("r <> ''")

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract("r", HEADER, i), F.lit(""))

    at = F.try_to_timestamp(F.concat_ws(".", part(1), part(2)), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    return rows.select(F.col("ord").cast("long").alias("ord"), at.alias("log_ts"), part(3).alias("level"), part(4).alias("session_id"), part(5).alias("log_type"), part(6).alias("body"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log folder or file. A file is one record of text, as its records have no fixed separator; rotate logs accordingly."""
    return parse_log(spark.read.text(path, wholetext=True))


def log_events(log: DataFrame) -> DataFrame:
    """The JSON events of a log: (ord, log_ts, session_id, log_type, type, message, task_description)."""
    body = F.from_json("body", "type string, session_id string, data struct<message:string,task_description:string>")
    return log.filter("log_type IS NOT NULL").withColumn("e", body).select("ord", "log_ts", "session_id", "log_type", "e.type", "e.data.message", "e.data.task_description")


def log_lines(events: DataFrame, level: str = "INFO") -> Column:
    """A record for each row of (at, session_id, log_type, body), as a column of the frame."""
    return F.concat(F.date_format("at", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(f" - {level} - ["), "session_id", F.lit("] "), "log_type", F.lit(": "), "body")


def append_log(events: DataFrame, path: str) -> None:
    events.select(log_lines(events).alias("value")).write.mode("append").text(path)


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that appear in a log folder, one row per file; parse_log() takes it."""
    return spark.readStream.text(folder, wholetext=True)
