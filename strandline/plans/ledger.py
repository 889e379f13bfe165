"""Calls that are made once: a table of answers by request key, written once and read by all that need them.

The table is a folder of runs. A run asks for the keys that no committed run has, in slices, each of which is a job of its own:
when a run breaks off, the slices it has written stay and are not asked for again. One run at a time may add to a folder.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import file_system, workers_import

ANSWER = "key string, output string, error string, attempts long"


def request_key(*parts: Column) -> Column:
    """A key for what a request says; nulls differ from empty parts."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), p), F.lit("")) for p in parts])), 256)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's rows: ANSWER, one for each key."""
    fs, where = file_system(spark, folder)
    runs = [str(s.getPath()) for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []
    done = [r for r in runs if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{r}/_SUCCESS"))]
    return spark.read.schema(ANSWER).parquet(*done) if done else spark.createDataFrame([], ANSWER)


def call_once(requests: DataFrame, call: Callable[[str], str], folder: str, width: int = 8, attempts: int = 3, wait: float = 0.2, slices: int = 1) -> DataFrame:
    """The answers to requests (key, payload): ANSWER rows of their keys, from the folder's ledger, which gets those it lacks.

    Requests of one key are one request. A task makes ``width`` calls at a time; a call that raises is made up to ``attempts``
    times, after wait, 2 x wait, ... seconds, and its last error is the answer then. Errors are kept like outputs.
    """
    spark = requests.sparkSession
    workers_import(spark)

    def one(key: str, payload: str | None) -> tuple:
        error = None
        for i in range(attempts):
            if i:
                time.sleep(wait * 2 ** (i - 1))
            try:
                return key, call(payload), None, i + 1
            except Exception as e:  # a failing call is an answer, not the job's end
                error = str(e)
        return key, None, error, attempts

    def ask(frames: Iterator) -> Iterator:
        import pandas as pd

        with ThreadPoolExecutor(width) as pool:
            for f in frames:
                yield pd.DataFrame(list(pool.map(one, f["key"], f["payload"])), columns=["key", "output", "error", "attempts"])

    wanted = requests.groupBy("key").agg(F.min("payload").alias("payload"))
    part = F.pmod(F.xxhash64("key"), F.lit(slices))
    for i in range(slices):
        todo = wanted.filter(part == i).join(answers(spark, folder).select("key"), "key", "left_anti")
        if not todo.isEmpty():
            todo.mapInPandas(ask, ANSWER).write.parquet(f"{folder.rstrip('/')}/run-{uuid.uuid4().hex}")
    return answers(spark, folder).join(wanted.select("key"), "key", "left_semi")
