"""Event operators: routing, response sequences, update mapping, history rules, feedback, UI flags, aliases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.names import missing_as_null
from strandline.operators.sequences import carry_forward, first_rows, is_first

#: Agent update -> wire event; anything else is a raw_event.
UPDATE_EVENTS: dict[str, str] = {
    "assistant_message": "text_message_content",
    "tool_selected": "tool_call_start",
    "tool_result": "tool_call_result",
    "pipeline_updated": "state_delta",
    "conversation_complete": "run_finished",
    "error": "run_error",
}
#: Which branch handles an incoming event; anything else is answered with a raw_event.
ROUTES: dict[str, str] = {"user_message": "message", "session_start": "start", "validation_request": "validation", "human_feedback": "feedback"}
#: Rows a connection gets at most: a page's stream, a chat's stream.
STREAM_CAP, CHAT_CAP = 50, 100


def mapped(value: Column, table: Mapping[str, str], default: str) -> Column:
    """A literal lookup with a default; null gets the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, F.coalesce(value, F.lit(""))), F.lit(default))


def update_event(update_type: Column, table: Mapping[str, str] = UPDATE_EVENTS) -> Column:
    return mapped(update_type, table, "raw_event")


def route(event_type: Column, table: Mapping[str, str] = ROUTES) -> Column:
    return mapped(event_type, table, "unhandled")


def responses(messages: DataFrame, updates: DataFrame, dedupe_terminal: bool = False, welcome: str = "Hello! What would you like to analyze?") -> DataFrame:
    """The events that answer user messages: (session_id, message_ord, seq, type, content).

    messages: session_id, ord, failed (null, or the error of a run that broke); updates: session_id, message_ord, ord,
    type, content. For each message: the welcome (a session's first message only), run_started, the updates' events, a
    run_error if the run broke, run_finished. A complete run reports run_finished as its last update already, so it
    comes twice; dedupe_terminal keeps the last only. messages may have a column greeted: whether the session had its welcome before.
    """
    greeted = F.coalesce("greeted", F.lit(False)) if "greeted" in messages.columns else F.lit(False)
    numbered = messages.withColumn("first", is_first(["session_id"], ["ord"]) & ~greeted)

    def row(stage: int, kind: str, content: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("type"), content.alias("content"))

    fixed = F.array_compact(F.array(
        F.when(F.col("first"), row(0, "text_message_content", F.lit(welcome))), row(1, "run_started", F.lit("Processing your request...")),
        F.when(F.col("failed").isNotNull(), row(3, "run_error", F.col("failed"))), row(4, "run_finished", F.lit("Response complete")),
    ))
    own = numbered.select("session_id", F.col("ord").alias("message_ord"), F.explode(fixed).alias("e")).select("session_id", "message_ord", "e.stage", F.lit(0).cast("long").alias("ord"), "e.type", "e.content")
    between = updates.select("session_id", "message_ord", F.lit(2).alias("stage"), F.col("ord").cast("long").alias("ord"), update_event(F.col("type")).alias("type"), "content")
    if dedupe_terminal:
        between = between.filter(F.col("type") != "run_finished")
    from strandline.operators.sequences import ordered

    both = own.unionByName(between)
    return both.withColumn("seq", F.row_number().over(ordered(["session_id", "message_ord"], ["stage", "ord"])).cast("long")).select("session_id", "message_ord", "seq", "type", "content")


def acknowledgements(events: DataFrame) -> DataFrame:
    """Two events for each validation request: (session_id, ord, seq, type, content). events: session_id, ord, item."""
    item = F.coalesce("item", F.lit("unknown"))
    rows = F.array(
        F.struct(F.lit(1).cast("long").alias("seq"), F.lit("custom_event").alias("type"), F.lit("Processing validation request").alias("content")),
        F.struct(F.lit(2).cast("long").alias("seq"), F.lit("text_message_content").alias("type"), F.concat(F.lit("I understand you want to validate: "), item, F.lit(". Please confirm if this looks correct.")).alias("content")),
    )
    return events.select("session_id", "ord", F.explode(rows).alias("r")).select("session_id", "ord", "r.*")


def feedback_events(events: DataFrame) -> DataFrame:
    """Approved: a text and a state_delta; else one text that asks for the change. events: session_id, ord, approved, comments."""
    approved = F.coalesce("approved", F.lit(False))
    comments = F.coalesce("comments", F.lit(""))
    note = F.when(comments != "", F.concat(F.lit("Note: "), comments)).otherwise("")
    ask = F.when(comments != "", comments).otherwise("What would you like me to change?")

    def row(seq: int, kind: str, content: Column) -> Column:
        return F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("type"), content.alias("content"))

    yes = F.array(row(1, "text_message_content", F.concat(F.lit("Great! I'll proceed with your approved pipeline. "), note)), row(2, "state_delta", F.lit("approved")))
    no = F.array(row(1, "text_message_content", F.concat(F.lit("I understand. Let me revise the approach. "), ask)))
    return events.select("session_id", "ord", F.explode(F.when(approved, yes).otherwise(no)).alias("r")).select("session_id", "ord", "r.*")


def start_events(events: DataFrame) -> DataFrame:
    return events.select("session_id", "ord", F.lit(1).cast("long").alias("seq"), F.lit("custom_event").alias("type"), F.lit("Session started successfully").alias("content"))


def unhandled_events(events: DataFrame) -> DataFrame:
    return events.select("session_id", "ord", F.lit(1).cast("long").alias("seq"), F.lit("raw_event").alias("type"), F.concat(F.lit("Unhandled event type: "), "type").alias("content"))


def history_entries(updates: DataFrame) -> DataFrame:
    """What updates add to a session: (session_id, ord, target, value): assistant texts to the history, named tools to the nodes."""
    target = F.when(F.col("type") == "assistant_message", "history").when((F.col("type") == "tool_selected") & (F.coalesce("tool_name", F.lit("")) != ""), "node")
    value = F.when(F.col("type") == "assistant_message", F.coalesce("content", F.lit(""))).otherwise(F.col("tool_name"))
    return updates.withColumn("target", target).filter("target IS NOT NULL").select("session_id", "ord", "target", value.alias("value"))


def flattened_updates(chunks: DataFrame) -> DataFrame:
    """Updates from the chunks of an agent run: (session_id, ord, type, content, tool_name).

    chunks: session_id, chunk_ord, error, nodes: array of (name, messages: array of (kind, content, name, tool_calls:
    array<string>), pipeline_nodes, pipeline_edges). Each assistant message is followed by its tool calls; a node that
    carries a pipeline ends with pipeline_updated; a session ends with conversation_complete, or with error.
    """
    node = chunks.select("session_id", "chunk_ord", F.posexplode("nodes").alias("node_ord", "node"))
    message = node.select("session_id", "chunk_ord", "node_ord", F.posexplode("node.messages").alias("message_ord", "m"))
    none = F.lit(None).cast("string")

    def row(kind: Column, content: Column, tool: Column) -> Column:
        return F.struct(kind.alias("type"), content.alias("content"), tool.alias("tool_name"))

    said = F.array(row(F.lit("assistant_message"), F.col("m.content"), none))
    calls = F.transform(F.coalesce("m.tool_calls", F.array().cast("array<string>")), lambda c: row(F.lit("tool_selected"), none, c))
    result = F.array(row(F.lit("tool_result"), F.col("m.content"), F.col("m.name")))
    rows = F.when(F.col("m.kind") == "assistant", F.concat(said, calls)).when(F.col("m.kind") == "tool", result)
    flat = message.select("session_id", "chunk_ord", "node_ord", "message_ord", F.posexplode(rows).alias("part", "u")).select("session_id", F.struct("chunk_ord", "node_ord", F.col("message_ord").alias("a"), F.col("part").alias("b")).alias("at"), "u.*")
    last = F.lit(1 << 30)
    graph = node.filter("node.pipeline_nodes IS NOT NULL").select("session_id", F.struct("chunk_ord", "node_ord", last.alias("a"), F.lit(0).alias("b")).alias("at"), F.lit("pipeline_updated").alias("type"), F.concat_ws(",", F.col("node.pipeline_nodes").cast("string"), F.col("node.pipeline_edges").cast("string")).alias("content"), none.alias("tool_name"))
    ends = chunks.groupBy("session_id").agg(F.max("error").alias("error"))
    ends = ends.select("session_id", F.struct(F.lit(1 << 60).alias("chunk_ord"), last.alias("node_ord"), last.alias("a"), F.lit(0).alias("b")).alias("at"), F.when(F.col("error").isNull(), "conversation_complete").otherwise("error").alias("type"), F.coalesce("error", F.lit("completed")).alias("content"), none.alias("tool_name"))
    every = flat.unionByName(graph).unionByName(ends)
    from strandline.operators.sequences import ordered

    return every.withColumn("ord", F.row_number().over(ordered(["session_id"], ["at"])).cast("long")).select("session_id", "ord", "type", "content", "tool_name")


def folded_response(updates: DataFrame) -> DataFrame:
    """(session_id, content, tool_calls, updates): the last assistant text, all tool names in order, the number of updates."""
    text = F.when(F.col("type") == "assistant_message", F.struct("ord", "content"))
    tool = F.when(F.col("type") == "tool_selected", F.struct("ord", "tool_name"))
    return updates.groupBy("session_id").agg(
        F.coalesce(F.max(text)["content"], F.lit("")).alias("content"),
        F.transform(F.sort_array(F.collect_list(tool)), lambda s: s["tool_name"]).alias("tool_calls"),
        F.count(F.lit(1)).alias("updates"),
    )


#: What a page does with an event, under its old and its new name.
UI_ALIASES: dict[str, str] = {
    "run_started": "start", "connection_established": "start", "text_message_content": "text", "assistant_message": "text",
    "tool_call_start": "tool", "tool_selected": "tool", "tool_call_result": "result", "tool_result": "result",
    "state_delta": "state", "pipeline_updated": "state", "run_finished": "end", "conversation_complete": "end",
    "run_error": "error", "error": "error", "heartbeat": "ignore",
}


def ui_action(event_type: Column) -> Column:
    return mapped(event_type, UI_ALIASES, "other")


def ui_tool_name(*names: Column) -> Column:
    """The first name that is neither null nor empty, else 'Unknown Tool'."""
    return F.coalesce(*[missing_as_null(n) for n in names], F.lit("Unknown Tool"))


def ui_flags(events: DataFrame, keys: list[str], order: list[str], action: Column) -> DataFrame:
    """events with ``streaming`` and ``loading`` after each: start sets both, text clears streaming, end and error clear both."""
    streaming = F.when(action == "start", True).when(action.isin("text", "end", "error"), False)
    loading = F.when(action == "start", True).when(action.isin("end", "error"), False)
    out = events.withColumn("streaming", F.coalesce(carry_forward(streaming, keys, order), F.lit(False)))
    return out.withColumn("loading", F.coalesce(carry_forward(loading, keys, order), F.lit(False)))


def ui_node_counter(events: DataFrame, keys: list[str], order: list[str], nodes: Column) -> DataFrame:
    """events with ``nodes_now``, the last known number of nodes, and ``announce``, whether this row tells of more than none."""
    out = events.withColumn("nodes_now", carry_forward(nodes, keys, order))
    return out.withColumn("announce", F.coalesce(nodes > 0, F.lit(False)))


def capped(events: DataFrame, keys: list[str], order: list[str], k: int = STREAM_CAP) -> DataFrame:
    return first_rows(events, keys, order, k)


def with_message(events: DataFrame, message: str = "message") -> tuple[DataFrame, DataFrame]:
    """(rows with a message, rejected rows): a message must not be null or empty."""
    ok = F.coalesce(F.length(F.col(message)) > 0, F.lit(False))
    return events.filter(ok), events.filter(~ok).withColumn("error", F.lit("Message is required"))
