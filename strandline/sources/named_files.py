"""A sink of whole files: each row (name, body) becomes one file of a folder, and all of them appear when the job has succeeded.

    spark.dataSource.register(NamedFiles)
    rows.write.format("named_files").mode("append").save(folder)

Tasks write into a staging folder of the job. The commit moves what successful tasks have written to its place, file by file, and
drops the rest, so a failed task or job leaves no file and no half one among them. A task that still runs when its job is given up
may write on in the staging folder, which is hidden from readers. A file that is there is replaced. Of rows of one name,
one stays: make names unique before. Names may have slashes, but can't lead out of the folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from strandline.session import workers_import
from strandline.sources.paths import opened


@dataclass
class Staged(WriterCommitMessage):
    task: str


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _staging(self, where: str) -> str:
        return f"{where}/_staged-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, where = opened(self.path)
        task, made = uuid.uuid4().hex, set()
        for row in iterator:
            name = row["name"]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a file's name: {name!r}")
            path = f"{self._staging(where)}/{task}/{name}"
            if (folder := path.rsplit("/", 1)[0]) not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(path) as out:
                out.write((row["body"] or "").encode())
        return Staged(task)

    def commit(self, messages: list) -> None:
        system, where = opened(self.path)
        made = set()
        for m in messages:
            top = f"{self._staging(where)}/{m.task}"
            for f in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
                if f.type != fs.FileType.File:
                    continue
                target = f"{where}/{f.path[len(top) + 1 :]}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                system.move(f.path, target)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, where = opened(self.path)
        if system.get_file_info(self._staging(where)).type == fs.FileType.Directory:
            system.delete_dir(self._staging(where))


class NamedFiles(DataSource):
    """Option: path. A sink only."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str) -> None:
    """Write rows of (name, body) as files of a folder."""
    workers_import(rows.sparkSession)
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "body").write.format("named_files").mode("append").save(folder)
