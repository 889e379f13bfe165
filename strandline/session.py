"""Session construction for local runs and tests; on a cluster the caller brings its own session."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[tuple[SparkSession, str]] = []


def local_session(cores: int | None = None, shuffle_partitions: int | None = None, app: str = "strandline") -> SparkSession:
    """A local session with AQE and UTC. An existing session is returned as it is."""
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STRANDLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workers_import(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the library from where the driver did."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, deleted by release_folders() or when the process ends. Where that is unset, a
    local session gets one of its own; on a cluster that would be another disk on each machine, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        path = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    elif not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    else:
        path = tempfile.mkdtemp(prefix=f"strandline-{name}-")
    _FOLDERS.append((spark, path))
    return path


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop sees them, so that a folder may be in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote to the folder has been committed."""
    fs, where = file_system(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(where)


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table at the path: written there unless it has been, and read again. What is read twice is then made once."""
    spark = df.sparkSession
    if not is_written(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_folders() -> None:
    """Delete the folders of shared_folder(), when nothing reads from them any more."""
    while _FOLDERS:
        spark, path = _FOLDERS.pop()
        try:
            fs, where = file_system(spark, path)
            fs.delete(where, True)
        except Exception:  # the session has ended; nothing can be deleted through it any more
            pass


atexit.register(release_folders)
