"""Planning without a model: keyword rules, plan conversion with defaults, and the plan of a failed planning.

A planner is any callable from a DataFrame (request_id, query) to (request_id, output) where output is a JSON string of
PLAN_OUTPUT; plan_requests() converts what it returns and falls back to the rules where the JSON does not fit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.schemas import PLAN_OUTPUT, STEP
from strandline.session import written


@dataclass(frozen=True)
class IntentRule:
    """A step for requests that contain one of the words, as a substring and whatever the case."""

    words: tuple[str, ...]
    tool: str
    reasoning: str


#: The rules in order, and the step where none applies.
RULES: tuple[IntentRule, ...] = (
    IntentRule(("speech", "spoken", "audio", "transcribe"), "whisper-wrapper", "Extract spoken text from audio"),
    IntentRule(("text", "ocr", "read", "visual"), "easyocr-wrapper", "Extract text from video frames"),
    IntentRule(("scene", "shot", "segment"), "swt-detection", "Detect scenes and segments"),
)
DEFAULT = IntentRule((), "whisper-wrapper", "General audio analysis")
#: Types of a rule-made plan, its confidence and seconds for each step; those of a failed planning.
INPUT_TYPES, OUTPUT_TYPES = ("VideoDocument",), ("TextDocument",)
CONFIDENCE, STEP_SECONDS, FAILED_CONFIDENCE, STEP_DEFAULT_SECONDS = 0.5, 60, 0.1, 30


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _step(tool: Column, reasoning: Column, seconds: int) -> Column:
    return F.struct(tool.alias("tool_name"), F.create_map().cast("map<string,string>").alias("parameters"), F.lit(None).cast("string").alias("config"), reasoning.alias("reasoning"), F.lit(seconds).alias("estimated_time"))


def matched_tools(query: Column, rules: Sequence[IntentRule] = RULES, default: IntentRule = DEFAULT) -> Column:
    """The tools of the rules that apply, in rule order; the default's where none does."""
    low = F.lower(query)
    hits = F.array_compact(F.array(*[F.when(F.exists(_strings(r.words), lambda w: F.contains(low, w)), F.lit(r.tool)) for r in rules]))
    return F.when(F.size(hits) > 0, hits).otherwise(_strings([default.tool]))


def rule_plan(query: Column, rules: Sequence[IntentRule] = RULES, default: IntentRule = DEFAULT) -> Column:
    """A plan by the rules, as a struct (steps, reasoning, estimated_total_time, confidence, input_types, output_types)."""
    low = F.lower(query)
    steps = F.array_compact(F.array(*[F.when(F.exists(_strings(r.words), lambda w: F.contains(low, w)), _step(F.lit(r.tool), F.lit(r.reasoning), STEP_DEFAULT_SECONDS)) for r in rules]))
    steps = F.when(F.size(steps) > 0, steps).otherwise(F.array(_step(F.lit(default.tool), F.lit(default.reasoning), STEP_DEFAULT_SECONDS)))
    return F.struct(
        steps.alias("steps"), F.concat(F.lit("Fallback plan for: "), query).alias("reasoning"), (F.size(steps) * STEP_SECONDS).alias("estimated_total_time"),
        F.lit(CONFIDENCE).alias("confidence"), _strings(INPUT_TYPES).alias("input_types"), _strings(OUTPUT_TYPES).alias("output_types"),
    )


def failure_plan(query: Column, error: Column, tool: str = DEFAULT.tool) -> Column:
    """The minimal plan of a planning that failed."""
    step = _step(F.lit(tool), F.concat(F.lit("Fallback plan due to planning error: "), error), STEP_SECONDS)
    return F.struct(
        F.array(step).alias("steps"), F.concat(F.lit("Fallback plan for query: "), query, F.lit(". Error: "), error).alias("reasoning"), F.lit(STEP_SECONDS).alias("estimated_total_time"),
        F.lit(FAILED_CONFIDENCE).alias("confidence"), _strings(INPUT_TYPES).alias("input_types"), _strings(OUTPUT_TYPES).alias("output_types"),
    )


def converted(output: Column) -> Column:
    """A planner's struct (PLAN_OUTPUT) as a plan, with each step's defaults; the total time is taken as it is."""
    def step(s: Column) -> Column:
        return F.struct(
            F.coalesce(s["tool_name"], F.lit("")).alias("tool_name"), F.coalesce(s["parameters"], F.create_map().cast("map<string,string>")).alias("parameters"),
            s["config"].alias("config"), F.coalesce(s["reasoning"], F.lit("")).alias("reasoning"), F.coalesce(s["estimated_time"], F.lit(STEP_DEFAULT_SECONDS)).alias("estimated_time"),
        )

    return F.struct(
        F.transform(output["steps"], step).alias("steps"), output["reasoning"].alias("reasoning"), output["estimated_time"].alias("estimated_total_time"),
        output["confidence"].alias("confidence"), output["input_types"].alias("input_types"), output["output_types"].alias("output_types"),
    )


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def parsed(text: Column) -> Column:
    """A planner's JSON as a struct, null if it is not one or lacks a required field."""
    def full(got: Column) -> Column:
        fields = ("steps", "reasoning", "confidence", "input_types", "output_types", "estimated_time")
        return F.when(reduce(lambda a, b: a & b, [got[f].isNotNull() for f in fields]), got)

    return once(F.from_json(text, PLAN_OUTPUT, {"mode": "PERMISSIVE"}), full)


def plan_requests(requests: DataFrame, planner: Callable[[DataFrame], DataFrame] | None = None, rules: Sequence[IntentRule] = RULES, path: str | None = None) -> DataFrame:
    """request_id, query, plan for requests (request_id, query).

    Without a planner, or where its output does not parse, the rules make the plan. A planner may give a column error;
    where that is set the plan is the one of a failed planning. A planner runs whenever the result is evaluated; with a path,
    its output is written there and read from then on, so that it runs once.
    """
    if planner is None:
        return requests.select("request_id", "query", rule_plan(F.col("query"), rules).alias("plan"))
    out = planner(requests)
    if "error" not in out.columns:
        out = out.withColumn("error", F.lit(None).cast("string"))
    out = out.select("request_id", "output", "error")
    both = requests.join(out if path is None else written(out, path), "request_id", "left")
    ruled = rule_plan(F.col("query"), rules)
    given = once(parsed(F.col("output")), lambda p: F.when(p.isNotNull(), converted(p)).otherwise(ruled))
    plan = F.when(F.col("error").isNotNull(), failure_plan(F.col("query"), F.col("error"))).otherwise(given)
    return both.select("request_id", "query", plan.alias("plan"))


def plan_steps(plans: DataFrame, key: str = "request_id", keep: Sequence[str] = ()) -> DataFrame:
    """One row for each step: key, step (from 1), the step's fields, and the plan's fields named in ``keep``."""
    rows = plans.select(key, F.posexplode("plan.steps").alias("_i", "_s"), *[F.col(f"plan.{k}").alias(k) for k in keep])
    return rows.select(key, (F.col("_i") + 1).cast("long").alias("step"), *[F.col(f"_s.{f.name}").alias(f.name) for f in STEP], *keep)
