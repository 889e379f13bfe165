"""A sink of wire frames that a batch reaches once, however often it is run.

    spark.dataSource.register(FrameSink)
    frames.writeStream.format("frame_sink").option("path", folder)...

Rows are (session_id, ord, frame). A task stages one file, its rows by session and ord; deal the stream by session first, and a
session's frames of a batch lie in one file in order. A commit moves the staged files into the batch's folder and marks it;
a batch that is marked already is left as it is, and staged files of tasks that failed are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from strandline.sources.paths import files_below, opened
from strandline.sources.tail import RecordTail

MARK = "_DONE"


@dataclass
class Staged(WriterCommitMessage):
    name: str | None


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch-{batch_id:012d}"


class FrameWriter(DataSourceStreamWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Staged:
        rows = sorted(((r["session_id"], r["ord"], r["frame"]) for r in iterator), key=lambda r: (r[0] or "", r[1]))  # a task's share of one batch
        if not rows:
            return Staged(None)
        system, where = opened(self.path)
        system.create_dir(f"{where}/_staged", recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{where}/_staged/{name}") as out:
            for _, _, frame in rows:
                out.write(frame.encode())
        return Staged(name)

    def commit(self, messages: list, batchId: int) -> None:
        system, where = opened(self.path)
        folder = batch_folder(where, batchId)
        if system.get_file_info(f"{folder}/{MARK}").is_file:
            return self.abort(messages, batchId)
        if system.get_file_info(folder).type.name == "Directory":  # a commit that broke off
            system.delete_dir_contents(folder)
        system.create_dir(folder, recursive=True)
        for i, m in enumerate(m for m in messages if m is not None and m.name):
            system.move(f"{where}/_staged/{m.name}", f"{folder}/part-{i:06d}.sse")
        with system.open_output_stream(f"{folder}/{MARK}"):
            pass

    def abort(self, messages: list, batchId: int) -> None:
        system, where = opened(self.path)
        for m in messages:
            if m is not None and m.name and system.get_file_info(f"{where}/_staged/{m.name}").is_file:
                system.delete_file(f"{where}/_staged/{m.name}")


class FrameSink(DataSource):
    """Option: path. A sink of streams only."""

    @classmethod
    def name(cls) -> str:
        return "frame_sink"

    def schema(self) -> str:
        return "session_id string, ord long, frame string"

    def streamWriter(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record) of the frames of committed batches."""
    system, where = opened(path)
    spark.dataSource.register(RecordTail)
    frames = spark.read.format("record_tail").option("kind", "frames").load(path)
    batches = {f.rsplit("/", 2)[-2] for f, _ in files_below(path)}
    open_ones = sorted(b for b in batches if not system.get_file_info(f"{where.rstrip('/')}/{b}/{MARK}").is_file)
    for b in open_ones:  # at most the batch being committed
        frames = frames.filter(~frames["file"].contains(f"/{b}/"))
    return frames
