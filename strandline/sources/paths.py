"""Folders as data sources see them: in Python processes beside Spark, so through Arrow's file systems instead of Hadoop's.

A plain path or file:// is a folder that driver and executors share; s3://, gs:// and hdfs:// go to those stores.
"""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def files_below(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, by path; hidden ones are left out, as is what lies in hidden folders."""
    system, where = opened(path)
    found = system.get_file_info(fs.FileSelector(where, recursive=True, allow_not_found=True))
    inside = len(where.rstrip("/")) + 1
    shown = [(f.path, f.size) for f in found if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[inside:].split("/"))]
    return sorted(shown)
