"""Catalog sources and sinks: an index of apps, one detail per app, snapshots."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.schemas import CATALOG, DETAIL, INDEX_ENTRY, L, struct
from strandline.session import workers_import


def index_rows(index: dict) -> list[tuple]:
    """(ord, app_url, description, latest_update, versions) of an index object, in its order."""
    return [(i, url, e.get("description", ""), e.get("latest_update"), e.get("versions") or []) for i, (url, e) in enumerate(index.items())]


def detail_row(name: str, detail: dict) -> tuple:
    """A detail object in one form: every input slot a list of alternatives, defaults as JSON strings. {} gives empty arrays."""
    def kind(t: dict) -> tuple:
        return t.get("@type", "unknown"), bool(t.get("required", False)), {k: v if isinstance(v, str) else json.dumps(v) for k, v in (t.get("properties") or {}).items()}

    slots = [[kind(t) for t in (s if isinstance(s, list) else [s])] for s in detail.get("input") or []]
    parameters = [(p.get("name", "unknown"), p.get("description", ""), p.get("type", ""), None if p.get("default") is None else p["default"] if isinstance(p["default"], str) else json.dumps(p["default"])) for p in detail.get("parameters") or []]
    return name, slots, [kind(t) for t in detail.get("output") or []], parameters


def index_frame(spark: SparkSession, index: dict) -> DataFrame:
    return spark.createDataFrame(index_rows(index), struct(ord=L, **{f.name: f.dataType for f in INDEX_ENTRY}))


def detail_frame(spark: SparkSession, details: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame([detail_row(n, d) for n, d in details.items()], DETAIL)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index file (one JSON object). What is no JSON object raises."""
    text = spark.read.text(path, wholetext=True).first()
    index = json.loads(text["value"] if text else "")
    if not isinstance(index, dict):
        raise ValueError("an index is a JSON object")
    return index_frame(spark, index)


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """A folder {app}/{version}/metadata.json or {app}.json read in parallel: (app_name, body)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    name = F.when(F.element_at(F.split("path", "/"), -1) == "metadata.json", F.element_at(F.split("path", "/"), -3)).otherwise(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", ""))
    return files.select(name.alias("app_name"), F.decode("content", "UTF-8").alias("body"))


def parse_details(bodies: DataFrame) -> DataFrame:
    """DETAIL rows of (app_name, body); a body that is no JSON object gives empty arrays, so its app stays in the catalog."""
    def parse(frames):
        import pyarrow as pa

        for batch in frames:
            rows = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    detail = json.loads(body or "")
                except ValueError:
                    detail = {}
                n, slots, out, parameters = detail_row(name, detail if isinstance(detail, dict) else {})
                named = [{"type": t, "required": r, "properties": list(p.items())} for t, r, p in out]
                rows.append({"app_name": n, "input": [[{"type": t, "required": r, "properties": list(p.items())} for t, r, p in s] for s in slots], "output": named, "parameters": [dict(zip(("name", "description", "type", "default"), p, strict=True)) for p in parameters]})
            kind = pa.struct([("type", pa.string()), ("required", pa.bool_()), ("properties", pa.map_(pa.string(), pa.string()))])
            parameter = pa.struct([(c, pa.string()) for c in ("name", "description", "type", "default")])
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("app_name", pa.string()), ("input", pa.list_(pa.list_(kind))), ("output", pa.list_(kind)), ("parameters", pa.list_(parameter))]))

    workers_import(bodies.sparkSession)
    return bodies.select("app_name", "body").mapInArrow(parse, DETAIL)


def fetch_json(url: str, timeout: float = 30.0):
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return json.load(r)


def fetch_catalog(spark: SparkSession, base: str, get: Callable[[str], dict] = fetch_json) -> tuple[DataFrame, DataFrame]:
    """(index, details) from a catalog server. A failing index raises; a failing detail counts as empty. Once per session: keep the result."""
    index = get(base)
    details = {}
    for _, url, _, _, versions in index_rows(index):
        name = url.rsplit("/", 1)[-1]
        version = versions[0][0] if versions else "unknown"
        try:
            details[name] = get(f"{base.rstrip('/')}/{name}/{version}/metadata.json")
        except Exception:  # a tool without readable metadata stays in the catalog
            details[name] = {}
    return index_frame(spark, index), detail_frame(spark, details)


def write_snapshot(catalog: DataFrame, path: str, form: str = "parquet") -> None:
    catalog.write.mode("overwrite").format(form).save(path)


def read_snapshot(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(CATALOG).format(form).load(path)


