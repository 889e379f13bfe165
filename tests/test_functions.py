from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.functions import jsonx, names, text, types
from strandline.schemas import DETAIL, EVENT_TYPES


def one(spark, column, **values):
    kinds = {str: "string", int: "int", bool: "boolean", float: "double"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("c")).first()[0]


@pytest.mark.parametrize(
    ("uri", "legacy", "fixed", "space"),
    [
        ("http://h/vocabulary/VideoDocument/v1", "", "VideoDocument", "http://h/vocabulary/VideoDocument"),
        ("http://vocab.x/Token", "Token", "Token", "http://vocab.x"),
        ("abc", "abc", "abc", ""),
        ("http://h/Interval", "Inter", "Interval", "http://h"),
        ("http://h/TimeFrame/v1.2", "", "TimeFrame", "http://h/TimeFrame"),
    ],
)
def test_type_names(spark, uri, legacy, fixed, space):
    u = F.col("u")
    assert one(spark, types.short_type(u, "legacy"), u=uri) == legacy
    assert one(spark, types.short_type(u), u=uri) == fixed
    assert one(spark, types.namespace(u), u=uri) == space
    with pytest.raises(ValueError, match="other"):
        types.short_type(u, "other")


def test_names(spark):
    n = F.col("n")
    assert one(spark, names.app_name(n), n="http://x/apps/one") == "one"
    assert one(spark, names.slug(n), n="My Pipe") == "my_pipe"
    assert one(spark, names.pipeline_title(n), n="my_pipe.yaml") == "My Pipe"
    for value in ("my-ocr", "o'neil x2y", "ÉTÉ été", "", "a", "3d"):
        assert one(spark, names.title(n), n=value) == value.title()
    assert one(spark, names.latest_version(F.array(F.array(F.lit("v2"), F.lit("a")), F.array(F.lit("v1"), F.lit("b"))))) == "v2"
    assert one(spark, names.latest_version(F.array().cast("array<array<string>>"))) == "unknown"
    assert one(spark, names.display_name(F.lit(""), F.lit("http://x/y"), F.lit("id"))) == "y"
    assert one(spark, names.display_name(F.lit(""), F.lit(None).cast("string"), F.lit("id"))) == "id"
    assert one(spark, names.url_join(F.lit("http://x"), F.lit("app"), F.lit("v1"))) == "http://x/app/v1"


@pytest.mark.parametrize(("output", "failed"), [('{"error":"x"}', True), ('{"error":null}', True), ('{"a":1}', False), ("[1]", False), ('"error"', False), ("not json", False), ("", False), (None, False), ('{"a":{"error":1}}', False)])
def test_error_predicate(spark, output, failed):
    df = spark.createDataFrame([(output,)], "o string")
    assert df.select(jsonx.is_error(F.col("o"))).first()[0] is failed


def test_arguments(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("x y"))
    assert one(spark, jsonx.cli_arguments(m, F.lit(None).cast("string"), F.lit("in"))) == ["--a", "1", "--b", "x y", "in"]
    assert one(spark, jsonx.cli_arguments(F.create_map().cast("map<string,string>"), F.lit("c.yaml"), F.lit("in"))) == ["--config", "config/c.yaml", "in"]
    assert one(spark, jsonx.parameters_json(F.create_map().cast("map<string,string>"))) is None
    assert one(spark, jsonx.parse_parameters(F.lit("[1]"))) == {} and one(spark, jsonx.parse_parameters(F.lit('{"k": 2}'))) == {"k": "2"}
    assert one(spark, jsonx.choose_script(F.lit(False), F.lit(True))) == "app.py" and one(spark, jsonx.choose_script(F.lit(False), F.lit(False))) is None


def test_descriptions(spark):
    t = lambda name, required=False, **props: {"type": name, "required": required, "properties": props}
    row = ("a", [[t("A", True)], [t("B"), t(None)], []], [t("C", timeUnit="ms", labelset="['x', 'y']"), t("D", other="1")], [{"name": "p", "type": "int", "default": "0", "description": "how"}, {"name": None, "type": "", "default": None, "description": ""}])
    df = spark.createDataFrame([row], DETAIL)
    got = df.select(text.tool_description(F.lit("speech"), F.col("input"), F.col("output"), F.col("parameters"), F.lit("v1"))).first()[0]
    assert got == "Tool for speech.\n\nInputs:\n- A (required)\n- one of [B, unknown]\n\nOutputs:\n- C (timeUnit=ms, labelset=['x', 'y'])\n- D\n\nParameters:\n- p (int) = 0: how\n- unknown\n\nVersion: v1"
    assert one(spark, text.types_or(F.array().cast("array<string>"), "Any")) == "Any"
    assert one(spark, text.preview(F.col("t"), 3), t="abcdef") == "abc..." and one(spark, text.preview(F.col("t"), 3), t="a") == "a..."
    assert one(spark, text.sse_frame(F.lit("{}"))) == "data: {}\n\n"


def test_event_vocabulary():
    every = [e for family in EVENT_TYPES.values() for e in family]
    assert len(every) == len(set(every)) == 24 and len(EVENT_TYPES) == 7
