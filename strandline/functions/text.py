"""Text made of metadata: slots, outputs, parameters, tool descriptions, plan explanations, previews, SSE frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def describe_slot(slot: Column) -> Column:
    """'type' or 'type (required)'; alternatives as 'one of [a, b]'; null for a slot without any."""
    def name(t: Column) -> Column:
        return F.coalesce(t["type"], F.lit("unknown"))

    plain = F.concat(name(slot[0]), F.when(F.coalesce(slot[0]["required"], F.lit(False)), F.lit(" (required)")).otherwise(""))
    many = F.concat(F.lit("one of ["), F.array_join(F.transform(slot, name), ", "), F.lit("]"))
    return F.when(F.size(slot) == 1, plain).when(F.size(slot) > 1, many)


def describe_output(out: Column) -> Column:
    """'type' with ' (timeUnit=..., labelset=...)' where these properties are set."""
    def prop(key: str) -> Column:
        value = F.element_at(out["properties"], key)
        return F.when(value.isNotNull(), F.concat(F.lit(key + "="), value))

    props = F.concat_ws(", ", prop("timeUnit"), prop("labelset"))
    return F.concat(F.coalesce(out["type"], F.lit("unknown")), F.when(props != "", F.concat(F.lit(" ("), props, F.lit(")"))).otherwise(""))


def describe_parameter(p: Column) -> Column:
    """'name[ (type)][ = default][: description]'; a default of false or 0 is a default."""
    kind = F.when(F.coalesce(p["type"], F.lit("")) != "", F.concat(F.lit(" ("), p["type"], F.lit(")"))).otherwise("")
    default = F.when(p["default"].isNotNull(), F.concat(F.lit(" = "), p["default"])).otherwise("")
    about = F.when(F.coalesce(p["description"], F.lit("")) != "", F.concat(F.lit(": "), p["description"])).otherwise("")
    return F.concat(F.coalesce(p["name"], F.lit("unknown")), kind, default, about)


def bullets(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")


def tool_description(about: Column, inputs: Column, outputs: Column, parameters: Column, version: Column, kind: str = "Tool") -> Column:
    """The description of a tool: what for, inputs, outputs, parameters and version."""
    slots = F.filter(F.transform(inputs, describe_slot), lambda x: x.isNotNull())
    return F.concat(
        F.lit(kind + " for "), F.coalesce(about, F.lit("video analysis")),
        F.lit(".\n\nInputs:\n"), bullets(slots),
        F.lit("\n\nOutputs:\n"), bullets(F.transform(outputs, describe_output)),
        F.lit("\n\nParameters:\n"), bullets(F.transform(parameters, describe_parameter)),
        F.lit("\n\nVersion: "), F.coalesce(version, F.lit("unknown")),
    )


def types_or(types: Column, default: str) -> Column:
    """Comma-joined, or the default where there is none ('Any' for inputs, 'Various' for outputs)."""
    joined = F.concat_ws(", ", types)
    return F.when(joined == "", F.lit(default)).otherwise(joined)


def listing_line(name: Column, about: Column, inputs: Column, outputs: Column) -> Column:
    """A tool's two lines in a planner's listing."""
    return F.concat(F.lit("- "), name, F.lit(": "), F.coalesce(about, F.lit("")), F.lit("\n  Input: "), types_or(inputs, "Any"), F.lit(" | Output: "), types_or(outputs, "Various"))


def preview(text: Column, size: int = 200) -> Column:
    """The first characters and always three dots."""
    return F.concat(F.left(text, F.lit(size)), F.lit("..."))


def explanation(query: Column, plan: Column) -> Column:
    """A plan in words: overview, numbered steps with their settings, minutes and seconds, confidence in per cent."""
    def step(s: Column, i: Column) -> Column:
        parameters = F.when(F.coalesce(F.size(s["parameters"]), F.lit(0)) > 0, F.concat(F.lit("   Parameters: "), F.to_json(s["parameters"]), F.lit("\n"))).otherwise("")
        config = F.when(F.coalesce(s["config"], F.lit("")) != "", F.concat(F.lit("   Configuration: "), s["config"], F.lit("\n"))).otherwise("")
        return F.concat((i + 1).cast("string"), F.lit(". **"), s["tool_name"], F.lit("**: "), F.coalesce(s["reasoning"], F.lit("")), F.lit("\n"), parameters, config, F.lit("\n"))

    seconds = plan["estimated_total_time"]
    return F.concat(
        F.lit('Request: "'), query, F.lit('"\n\n**Overview:**\n'), plan["reasoning"], F.lit("\n\n**Steps:**\n"), F.array_join(F.transform(plan["steps"], step), ""),
        F.lit("\n**Estimated time:** "), F.floor(seconds / 60).cast("string"), F.lit(" minutes "), (seconds % 60).cast("string"), F.lit(" seconds\n**Confidence:** "), F.format_string("%.1f%%", plan["confidence"] * 100),
    )


def sse_frame(payload: Column) -> Column:
    """A server-sent-events frame around a JSON string, with real line breaks."""
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))
