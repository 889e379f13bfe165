"""Tools as functions: name -> callable from (input, parameters) to a string. A failing tool never raises out of a plan."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Tool = Callable[[str, dict], str]


@dataclass
class Registry:
    """The tools that plans may call, and the types they take and give."""

    tools: dict[str, Tool] = field(default_factory=dict)
    types: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)

    def add(self, name: str, tool: Tool, takes: tuple[str, ...] = (), gives: tuple[str, ...] = ()) -> Registry:
        self.tools[name] = tool
        self.types[name] = (takes, gives)
        return self

    def call(self, name: str, value: str, parameters: dict) -> tuple[bool, str | None, str | None]:
        """(success, output, error). A JSON object with a key 'error' is a failure, as is an exception or a missing tool."""
        if name not in self.tools:
            return False, None, f"Tool {name} not found"
        try:
            out = self.tools[name](value, parameters)
        except Exception as e:  # a tool's failure is a result
            return False, json.dumps({"error": str(e)}), str(e)
        if isinstance(out, str) and out.lstrip(" \t\n\r")[:1] != "{":  # no JSON object
            return True, out, None
        try:
            got = json.loads(out)
        except (TypeError, ValueError):
            return True, out, None
        if isinstance(got, dict) and "error" in got:
            return False, out, str(got["error"])
        return True, out, None

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, list(self.types[n][0]), list(self.types[n][1])) for n in sorted(self.tools)], "tool_name string, takes array<string>, gives array<string>")


def from_catalog(catalog: DataFrame, make: Callable[[str], Tool]) -> Registry:
    """A registry with a tool for each app of a catalog. Tools are functions on the driver; their number is the catalog's."""
    registry = Registry()
    for r in catalog.select("ord", "app_name").orderBy("ord").collect():
        registry.add(r["app_name"], make(r["app_name"]))
    return registry


def echo(value: str, parameters: dict) -> str:
    """A test double."""
    return json.dumps({"text": value, **parameters})


def command_tool(command: list[str], timeout: int = 300) -> Tool:
    """A tool that is a program: arguments by parameter, input on stdin, result on stdout. No shell, nothing is deleted."""
    def run(value: str, parameters: dict) -> str:
        args = [x for k, v in parameters.items() for x in (f"--{k}", str(v))]
        try:
            done = subprocess.run([*command, *args], input=value, capture_output=True, text=True, timeout=timeout)
        except subprocess.TimeoutExpired:
            return json.dumps({"error": f"timeout after {timeout} s"})
        return done.stdout if done.returncode == 0 else json.dumps({"error": done.stderr.strip() or f"exit code {done.returncode}"})

    return run
