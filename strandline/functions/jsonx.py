"""JSON predicates and command-line arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_key(text: Column, key: str) -> Column:
    """Whether a string is a JSON object with that key, whatever its value, null included. Never fails; null is no object."""
    return F.coalesce(F.array_contains(F.json_object_keys(F.when(F.try_parse_json(text).isNotNull(), text)), key), F.lit(False))


def is_error(output: Column) -> Column:
    """A tool's output means failure if it is a JSON object with a key 'error'; anything else is success."""
    return has_key(output, "error")


def parameters_json(parameters: Column) -> Column:
    """A map as JSON; null for an empty one."""
    return F.when(F.size(parameters) > 0, F.to_json(parameters))


def parse_parameters(text: Column) -> Column:
    """A JSON object as map<string,string>; null and what is no object give an empty map."""
    keys = F.json_object_keys(F.when(F.try_parse_json(text).isNotNull(), text))
    return F.coalesce(F.when(keys.isNotNull(), F.from_json(text, "map<string,string>")), F.create_map().cast("map<string,string>"))


def cli_arguments(parameters: Column, config: Column, input_path: Column) -> Column:
    """[--config config/x] --key value ... input, as array<string>."""
    named = F.flatten(F.transform(F.map_entries(parameters), lambda e: F.array(F.concat(F.lit("--"), e["key"]), e["value"])))
    head = F.when(F.coalesce(config, F.lit("")) != "", F.array(F.lit("--config"), F.concat(F.lit("config/"), config))).otherwise(F.array().cast("array<string>"))
    return F.concat(head, named, F.array(input_path))


def choose_script(has_cli: Column, has_app: Column) -> Column:
    """cli.py before app.py; null if there is neither."""
    return F.coalesce(F.when(has_cli, F.lit("cli.py")), F.when(has_app, F.lit("app.py")))
