"""A catalog server, or a folder laid out like one, as a table that loads in parallel.

    catalog_table(spark, base)  # or spark.read.format("tool_catalog").option("base", base).load()

The index is asked for once when a query is planned. Its apps are dealt into groups, each a partition whose task asks for the
details, some at a time. A filter on app_name, equal to or one of given names, reaches the source, so that looking up one app asks for
one detail. The source can't be told which columns a query needs; with ``details=False`` the three arrays are left out and no
detail is asked for. What can't be fetched or read as a detail gives empty arrays; an index that can't is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from strandline.schemas import CATALOG
from strandline.session import workers_import
from strandline.sources.catalogs import detail_row, fetch_json, index_rows
from strandline.sources.paths import opened

ARRAYS = ("input", "output", "parameters")


def _get(base: str, name: str, timeout: float):
    """A JSON object below the base; the index has an empty name."""
    if base.startswith(("http://", "https://")):
        return fetch_json(f"{base.rstrip('/')}/{name}" if name else base, timeout)
    system, where = opened(base)
    with system.open_input_stream(f"{where.rstrip('/')}/{name or 'index.json'}") as f:
        return json.loads(f.read())


def entries(index: dict) -> list[tuple]:
    """(ord, app_name, latest_version, description) of an index: a repeated name keeps its first place and its last values."""
    out: dict[str, tuple] = {}
    for i, url, description, _, versions in index_rows(index):
        name = url.rsplit("/", 1)[-1]
        out[name] = (out[name][0] if name in out else i, name, versions[0][0] if versions and versions[0] else "unknown", description)
    return list(out.values())


class Apps(InputPartition):
    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.base, self.fields = options["base"], schema.fieldNames()
        self.group, self.width, self.timeout = int(options.get("group", 8)), int(options.get("width", 8)), float(options.get("timeout", 30))
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("app_name",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            else:
                yield f

    def partitions(self) -> list[Apps]:
        index = _get(self.base, "", self.timeout)
        if not isinstance(index, dict):
            raise ValueError("an index is a JSON object")
        wanted = [e for e in entries(index) if self.names is None or e[1] in self.names]
        return [Apps(wanted[i : i + self.group]) for i in range(0, len(wanted), self.group)] or [Apps([])]

    def _row(self, entry: tuple) -> tuple:
        place, name, version, description = entry
        arrays: dict = {}
        if any(f in self.fields for f in ARRAYS):
            try:
                detail = _get(self.base, f"{name}/{version}/metadata.json", self.timeout)
                arrays = dict(zip(ARRAYS, detail_row(name, detail)[1:], strict=True))
            except Exception:  # a tool without readable metadata stays in the catalog
                arrays = dict.fromkeys(ARRAYS, [])
        values = {"ord": place, "app_name": name, "latest_version": version, "description": description, **arrays}
        return tuple(values[f] for f in self.fields)

    def read(self, partition: Apps) -> Iterator[tuple]:
        with ThreadPoolExecutor(self.width) as pool:
            yield from pool.map(self._row, partition.rows)


class ToolCatalog(DataSource):
    """Options: base, group (apps of a partition), width (details at a time in a task), timeout (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "tool_catalog"

    def schema(self) -> StructType:
        return CATALOG

    def reader(self, schema: StructType) -> CatalogReader:
        return CatalogReader(dict(self.options), schema)


def catalog_table(spark: SparkSession, base: str, details: bool = True, **options: object) -> DataFrame:
    """The catalog at a base as a DataFrame of CATALOG rows, or of its first four columns."""
    workers_import(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ToolCatalog)
    schema = CATALOG if details else StructType([f for f in CATALOG if f.name not in ARRAYS])
    return spark.read.format("tool_catalog").schema(schema).options(base=base, **options).load()
