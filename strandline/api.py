"""The service surface as calls on DataFrames: tools, pipelines, events, chats, exports, health.

Each call returns a DataFrame (or a small driver object where the answer is one by nature) and touches no network. A
web layer, if one is wanted, turns these rows into responses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import catalog as catalogs
from strandline.operators import events
from strandline.operators.lookups import session_pipeline
from strandline.plans import execution, graph, planner, stepwise
from strandline.plans.registry import Registry
from strandline.session import shared_folder
from strandline.sources import pipelines

#: An agent: from messages (session_id, message_ord, message) to updates (session_id, message_ord, ord, type, content, tool_name).
Agent = Callable[[DataFrame], DataFrame]


@dataclass
class Service:
    """catalog: the shaped catalog, loaded once; folder: where pipeline files are; agent: what answers messages."""

    spark: SparkSession
    catalog: DataFrame
    folder: str
    agent: Agent
    registry: Registry = field(default_factory=Registry)
    planner: Callable[[DataFrame], DataFrame] | None = None

    # ---- tools and pipelines

    def tools(self) -> DataFrame:
        return catalogs.describe_tools(self.catalog)

    def list_pipelines(self) -> DataFrame:
        return pipelines.list_names(self.spark, self.folder)

    def pipeline(self, name: str) -> DataFrame:
        return pipelines.load_one(self.spark, name, self.folder)

    def health(self) -> DataFrame:
        return catalogs.health(tools=self.catalog)

    # ---- events and chats

    def updates(self, incoming: DataFrame) -> DataFrame:
        """What the agent says to the messages of incoming events. It is asked whenever the result is evaluated."""
        fine, _ = events.with_message(incoming.filter(events.route(F.col("type")) == "message"))
        return self.agent(fine.select("session_id", F.col("ord").alias("message_ord"), "message"))

    def answer(self, incoming: DataFrame, updates: DataFrame | None = None) -> DataFrame:
        """All events that answer incoming ones: (session_id, ord, seq, type, content), each branch in its own way.

        incoming: session_id, ord, type, message, item, approved, comments, and greeted where sessions go on (see events.responses).
        Messages that are null or empty are rejected with a run_error. updates: what the agent has said to them already, if it has.
        """
        kind = events.route(F.col("type"))
        fine, rejected = events.with_message(incoming.filter(kind == "message"))
        messages = fine.select("session_id", "ord", F.lit(None).cast("string").alias("failed"), *[c for c in fine.columns if c == "greeted"])
        updates = self.updates(incoming) if updates is None else updates
        said = events.responses(messages, updates.select("session_id", "message_ord", "ord", "type", "content")).withColumnRenamed("message_ord", "ord")
        refused = rejected.select("session_id", "ord", F.lit(1).cast("long").alias("seq"), F.lit("run_error").alias("type"), F.col("error").alias("content"))
        parts = [
            said,
            refused,
            events.start_events(incoming.filter(kind == "start")),
            events.acknowledgements(incoming.filter(kind == "validation")),
            events.feedback_events(incoming.filter(kind == "feedback")),
            events.unhandled_events(incoming.filter(kind == "unhandled")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def welcome(self, sessions: DataFrame) -> DataFrame:
        """What a newly opened session gets: its start is acknowledged."""
        return events.start_events(sessions.select("session_id", F.lit(0).cast("long").alias("ord")))

    def stream(self, incoming: DataFrame, cap: int = events.STREAM_CAP, updates: DataFrame | None = None) -> DataFrame:
        """The first ``cap`` answer events of each session."""
        return events.capped(self.answer(incoming, updates), ["session_id"], ["ord", "seq"], cap)

    def chat(self, messages: DataFrame, updates: DataFrame | None = None) -> DataFrame:
        """The folded response of each session: last text, tool names, number of updates, whether a tool was added."""
        fine, _ = events.with_message(messages)
        updates = self.agent(fine.select("session_id", F.col("ord").alias("message_ord"), "message")) if updates is None else updates
        numbered = updates.withColumn("ord", F.struct("message_ord", "ord"))
        return events.folded_response(numbered).withColumn("tool_added", F.size("tool_calls") > 0)

    def session_pipelines(self, incoming: DataFrame, asked: DataFrame) -> DataFrame:
        """(session_id, pipeline, status) of asked sessions by the tools that the agent has selected in them."""
        updates = self.agent(events.with_message(incoming)[0].select("session_id", F.col("ord").alias("message_ord"), "message"))
        built = updates.filter(F.coalesce("tool_name", F.lit("")) != "").select("session_id").distinct().withColumn("pipeline", F.concat(F.lit("Pipeline-"), "session_id"))
        return session_pipeline(incoming.select("session_id").distinct(), built, asked)

    def export(self, nodes: DataFrame, edges: DataFrame, session_id: str, name: str | None = None) -> list[str]:
        """Write a session's pipeline to its file, under another name if one is given; the session keeps its own."""
        own = f"Pipeline-{session_id}"
        one = graph.to_struct(nodes.filter(F.col("pipeline") == own).select("pipeline").distinct(), nodes.filter(F.col("pipeline") == own), edges.filter(F.col("pipeline") == own))
        return [f"{self.folder.rstrip('/')}/{r['file']}" for r in pipelines.save(one, self.folder, name).collect()]  # of one pipeline

    # ---- requests

    def process(self, requests: DataFrame, auto_execute: bool = False, work: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(plans, results) for requests (request_id, query, input): each is planned once, and run once if asked to and valid.

        plans: request_id, query, plan, issues, status; results: plan_id, step, tool_name, success, output, error of the steps that
        ran. The planner's output and each round of steps are tables in the folder ``work`` (a new one by default), which both
        results are read from; a call with the folder of one that broke off goes on from what is there.
        """
        work = work or shared_folder(self.spark, "requests")
        plans = planner.plan_requests(requests.select("request_id", "query"), self.planner, path=f"{work}/planned")
        heads = plans.join(requests.select("request_id", "input"), "request_id")
        ids = heads.select(F.col("request_id").cast("string").alias("plan_id"), F.coalesce("input", F.lit("")).alias("input"))
        steps = planner.plan_steps(plans).select(F.col("request_id").cast("string").alias("plan_id"), "step", "tool_name", "parameters")
        known = self.registry.table(self.spark).select("tool_name") if self.registry.tools else self.catalog.select(F.col("app_name").alias("tool_name"))
        issues = execution.validate_plans(ids, steps, known).groupBy("plan_id").agg(F.count(F.lit(1)).alias("issues"))
        ready = ids.join(issues, "plan_id", "left_anti").filter("input <> ''") if auto_execute else ids.limit(0)
        results = stepwise.run_stepwise(ready, steps, self.registry, f"{work}/run")
        ends = execution.plan_outcomes(ready, results).select("plan_id", F.when(F.col("success"), "completed").otherwise("failed").alias("ended"))
        both = heads.withColumn("plan_id", F.col("request_id").cast("string")).join(issues, "plan_id", "left").join(ends, "plan_id", "left")
        status = execution.request_status(F.lit(auto_execute), F.coalesce("input", F.lit("")) != "", F.coalesce("issues", F.lit(0)), F.col("ended"), F.lit(None).cast("string"))
        return both.select("request_id", "query", "plan", F.coalesce("issues", F.lit(0).cast("long")).alias("issues"), status.alias("status")), results
