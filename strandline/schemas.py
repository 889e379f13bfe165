"""Spark schemas of the data model: catalogs, pipelines, plans, progress, events, sessions."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


#: An annotation type of a tool's input or output. A slot is an array of alternatives; one entry is a plain input.
TYPE = struct(type=S, required=B, properties=T.MapType(S, S))
PARAMETER = struct(name=S, description=S, type=S, default=S)
INDEX_ENTRY = struct(app_url=S, description=S, latest_update=S, versions=T.ArrayType(T.ArrayType(S)))
DETAIL = struct(app_name=S, input=T.ArrayType(T.ArrayType(TYPE)), output=T.ArrayType(TYPE), parameters=T.ArrayType(PARAMETER))
CATALOG = struct(ord=L, app_name=S, latest_version=S, description=S, input=T.ArrayType(T.ArrayType(TYPE)), output=T.ArrayType(TYPE), parameters=T.ArrayType(PARAMETER))

NODE = struct(pipeline=S, ord=L, id=S, tool_id=S, data=S, x=D, y=D)
EDGE = struct(pipeline=S, ord=L, id=S, source=S, target=S, edge_type=S)
PIPELINE = struct(name=S, nodes=T.ArrayType(struct(id=S, tool_id=S, data=S, x=D, y=D)), edges=T.ArrayType(struct(id=S, source=S, target=S)))

STEP = struct(tool_name=S, parameters=T.MapType(S, S), config=S, reasoning=S, estimated_time=I)
PLAN = struct(plan_id=S, steps=T.ArrayType(STEP), reasoning=S, estimated_total_time=I, confidence=D, input_types=T.ArrayType(S), output_types=T.ArrayType(S))
#: What a planner returns before conversion: steps may lack any field.
PLAN_OUTPUT = struct(steps=T.ArrayType(STEP), reasoning=S, confidence=D, input_types=T.ArrayType(S), output_types=T.ArrayType(S), estimated_time=I)
STEP_RESULT = struct(plan_id=S, step=L, tool_name=S, success=B, output=S, error=S, execution_time=D, start_time=T.TimestampType(), end_time=T.TimestampType())
PROGRESS = struct(plan_id=S, seq=L, current_step=L, total_steps=L, step_name=S, status=S, percentage=D)

UPDATE = struct(session_id=S, ord=L, type=S, content=T.MapType(S, S), timestamp=S)
EVENT = struct(session_id=S, ord=L, type=S, data=T.MapType(S, S), timestamp=S)
HISTORY = struct(role=S, content=S, approved=B, comments=S, timestamp=S)
SESSION = struct(session_id=S, task_description=S, history=T.ArrayType(HISTORY), nodes=T.ArrayType(S), created_at=S, welcome_sent=B)
RESPONSE = struct(thread_id=S, content=S, tool_calls=T.ArrayType(S), updates=L)
LOG = struct(log_ts=T.TimestampType(), session_id=S, log_type=S, body=S)

#: The wire event types, by family.
EVENT_TYPES: dict[str, tuple[str, ...]] = {
    "lifecycle": ("run_started", "run_finished", "run_error", "step_started", "step_finished"),
    "text": ("text_message_start", "text_message_content", "text_message_chunk", "text_message_end"),
    "tool": ("tool_call_start", "tool_call_args", "tool_call_chunk", "tool_call_end", "tool_call_result"),
    "thinking": ("thinking_start", "thinking_text_message_start", "thinking_text_message_content", "thinking_text_message_end", "thinking_end"),
    "state": ("state_delta", "state_snapshot"),
    "messages": ("messages_snapshot",),
    "custom": ("raw_event", "custom_event"),
}
