"""Shared pieces of the corpus operators: scratch tables in the cluster's shared folder, text helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import workers_import

__all__ = ["ascii_lower", "fresh", "labelled", "materialize", "python_workers", "release", "scratch_path", "shared_dir", "table"]

#: What Arrow hands to a Python worker at once: so many rows and, as far as a single row allows, so many bytes.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str, str]] = []
_LABELS = [""]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its
    own; on a cluster that would be another disk on each machine, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if "own" not in _OWN_DIR:
        _OWN_DIR["own"] = tempfile.mkdtemp(prefix="strandline-")
    return _OWN_DIR["own"]


def python_workers(spark: SparkSession) -> None:
    """Let Python workers import the library, and bound what both sides of a worker hold of its input: whole texts are long rows.
    A session that sets the sizes of Arrow batches itself keeps them."""
    workers_import(spark)
    for key, most in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


@contextmanager
def labelled(label: str) -> Iterator[None]:
    """Scratch tables written meanwhile carry this label, by which release() can tell them from others."""
    _LABELS.append(label)
    try:
        yield
    finally:
        _LABELS.pop()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which release() deletes."""
    path = f"{shared_dir(spark).rstrip('/')}/strandline-scratch/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path, _LABELS[-1]))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := scratch_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; nothing can be deleted through it any more
        pass


def release(label: str | None = None) -> None:
    """Delete the scratch tables with a label, or all. Call it only when what was built on them has been written."""
    for item in [x for x in _WRITTEN if label in (None, x[2])]:
        _WRITTEN.remove(item)
        _delete(*item[:2])


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is. lower() does just that on ASCII text, and far faster than translate()."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
