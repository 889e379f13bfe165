"""Pipeline files: YAML (JSON where no YAML library is installed), one file per pipeline, named by its slug."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.names import pipeline_title
from strandline.plans.graph import from_struct, to_struct
from strandline.schemas import PIPELINE
from strandline.session import file_system, workers_import
from strandline.sources.named_files import write_files

try:
    import yaml
except ImportError:  # JSON is YAML too
    yaml = None

if yaml:  # libyaml's, where PyYAML has it, read and write the same some eight times as fast
    _DUMPER, _LOADER = getattr(yaml, "CSafeDumper", yaml.SafeDumper), getattr(yaml, "CSafeLoader", yaml.SafeLoader)


#: Of so many pipelines at a time a task makes Python objects, which take some ten times the room of their rows.
FEW = 64


def dump(pipeline: dict) -> str:
    return yaml.dump(pipeline, Dumper=_DUMPER, sort_keys=False, allow_unicode=True) if yaml else json.dumps(pipeline, indent=2, ensure_ascii=False)


def load(text: str) -> dict:
    got = yaml.load(text, Loader=_LOADER) if yaml else json.loads(text)
    if not isinstance(got, dict):
        raise ValueError("a pipeline file holds one mapping")
    return got


def as_mapping(row) -> dict:
    """A pipeline as it stands in its file."""
    nodes = [{"id": n["id"], "tool_id": n["tool_id"], "data": json.loads(n["data"] or "{}"), "position": {"x": n["x"], "y": n["y"]}} for n in row["nodes"]]
    return {"name": row["name"], "nodes": nodes, "edges": [{k: e[k] for k in ("id", "source", "target")} for e in row["edges"]]}


def _row(d: dict) -> tuple:
    nodes = [(n["id"], n["tool_id"], json.dumps(n.get("data") or {}), float((n.get("position") or {}).get("x", 0)), float((n.get("position") or {}).get("y", 0))) for n in d.get("nodes") or []]
    return d.get("name"), nodes, [(e.get("id"), e["source"], e["target"]) for e in d.get("edges") or []]


def file_name(name: str) -> str:
    return name.lower().replace(" ", "_") + ".yaml"


def file_texts(batches: Iterator, name: str | None = None) -> Iterator:
    """Arrow batches (name, body) of the files of Arrow batches (file, name, nodes, edges), FEW at a time."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, FEW):
            rows = batch.slice(at, FEW).to_pylist()
            bodies = [dump({**as_mapping(r), "name": name or r["name"]}) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["file"] for r in rows], pa.string()), pa.array(bodies, pa.string())], ["name", "body"])


def parsed(frames: Iterator) -> Iterator:
    """Frames (name, nodes, edges) of frames (value) of files' texts, FEW at a time."""
    import pandas as pd

    for f in frames:
        for at in range(0, len(f), FEW):
            rows = [_row(load(text)) for text in f["value"].iloc[at : at + FEW]]
            as_dicts = [(n, [dict(zip(("id", "tool_id", "data", "x", "y"), x, strict=True)) for x in nodes], [dict(zip(("id", "source", "target"), x, strict=True)) for x in edges]) for n, nodes, edges in rows]
            yield pd.DataFrame(as_dicts, columns=["name", "nodes", "edges"])


def save(pipelines: DataFrame, folder: str, name: str | None = None) -> DataFrame:
    """Write each pipeline of (name, nodes, edges) to its own file, under another name if one is given: (file, name) of all files.

    Of pipelines of one file name the one whose name is last in order is written. Tasks write; see named_files for what a failure
    leaves, which is nothing.
    """
    workers_import(pipelines.sparkSession)
    file = F.concat(F.replace(F.lower(F.lit(name) if name else F.col("name")), F.lit(" "), F.lit("_")), F.lit(".yaml"))
    last = F.max_by(F.struct("name", "nodes", "edges"), "name")
    one = pipelines.groupBy(file.alias("file")).agg(last.alias("p")).select("file", "p.*")
    write_files(one.mapInArrow(partial(file_texts, name=name), "name string, body string"), folder)
    return pipelines.select(file.alias("file"), (F.lit(name) if name else F.col("name")).alias("name")).distinct()


def load_one(spark: SparkSession, name_or_path: str, folder: str) -> DataFrame:
    """A pipeline by its path, else by its name in the folder; FileNotFoundError if there is neither."""
    for path in (name_or_path, f"{folder.rstrip('/')}/{file_name(name_or_path)}"):
        fs, where = file_system(spark, path)
        if fs.exists(where) and fs.getFileStatus(where).isFile():
            return spark.createDataFrame([_row(load(spark.read.text(path, wholetext=True).first()["value"]))], PIPELINE)
    raise FileNotFoundError(f"Pipeline not found: {name_or_path}")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All pipelines of a folder, parsed in parallel: (name, nodes, edges)."""
    workers_import(spark)
    return spark.read.option("pathGlobFilter", "*.yaml").text(folder, wholetext=True).mapInPandas(parsed, PIPELINE)


def list_names(spark: SparkSession, folder: str) -> DataFrame:
    """The listed names of the .yaml files of a folder, by file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.select("file", pipeline_title(F.url_decode("file")).alias("name")).orderBy("file")


def round_trip(spark: SparkSession, names: DataFrame, nodes: DataFrame, edges: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    save(to_struct(names, nodes, edges), folder)
    return from_struct(read_folder(spark, folder))
