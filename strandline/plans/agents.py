"""Models behind planners and agents: connectors to chat servers, a planner that asks one, and the tool loop.

A model is a callable from a list of messages (dicts of role and content) to a text; the connectors below are such, and
so is any function, which is what tests use. Calls run on the executors. A frame that calls a model does so each time it is
evaluated; model_planner() with a folder, and Service.process(), keep what was answered.
"""

from __future__ import annotations

import asyncio
import json
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import LlmConfig
from strandline.plans.ledger import call_once, request_key
from strandline.plans.registry import Registry
from strandline.session import workers_import

Model = Callable[[list[dict]], str]
UPDATES = "session_id string, message_ord long, ord long, type string, content string, tool_name string"


def post_json(url: str, body: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})  # noqa: S310
    with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
        return json.load(r)


def chat_model(config: LlmConfig, key: str = "", timeout: float = 120.0, post: Callable[[str, dict, dict, float], dict] = post_json) -> Model:
    """A connector to the server that the configuration names: provider 'ollama', or 'openai' for servers of that form."""
    base, head = config.base_url.rstrip("/"), [{"role": "system", "content": config.system_prompt}] if config.system_prompt else []

    def ollama(messages: list[dict]) -> str:
        options = {"temperature": config.temperature, "top_p": config.top_p, "num_predict": config.max_length}
        got = post(f"{base}/api/chat", {"model": config.model_name, "messages": head + messages, "stream": False, "options": options}, {}, timeout)
        return got["message"]["content"]

    def openai(messages: list[dict]) -> str:
        body = {"model": config.model_name, "messages": head + messages, "temperature": config.temperature, "top_p": config.top_p, "max_tokens": config.max_length}
        got = post(f"{base}/chat/completions", body, {"Authorization": f"Bearer {key}"} if key else {}, timeout)
        return got["choices"][0]["message"]["content"]

    kinds = {"ollama": ollama, "openai": openai}
    if config.provider not in kinds:
        raise ValueError(f"provider {config.provider}")
    return kinds[config.provider]


def model_planner(model: Model, tools: str = "", folder: str | None = None, width: int = 8, attempts: int = 3) -> Callable[[DataFrame], DataFrame]:
    """A planner for plan_requests(): asks the model for each request; what fails becomes the request's error.

    tools: the listing of the tools that the model may plan with. With a folder, answers are kept in the ledger there: equal requests
    are asked once between them, now and in later runs, ``width`` at a time in a task, each up to ``attempts`` times.
    """
    task = f"Plan which tools answer the request. Tools:\n{tools}\nReply with one JSON object: steps (tool_name, parameters, config, reasoning, estimated_time), reasoning, confidence, input_types, output_types, estimated_time."

    def asked(query: str) -> str:
        return model([{"role": "system", "content": task}, {"role": "user", "content": query}])

    def ask(frames: Iterator) -> Iterator:
        for f in frames:
            outputs, errors = [], []
            for query in f["query"]:
                try:
                    outputs.append(asked(query))
                    errors.append(None)
                except Exception as e:  # a failing model is a plan's error, not the job's
                    outputs.append(None)
                    errors.append(str(e))
            yield f[["request_id"]].assign(output=outputs, error=errors)

    def plan(requests: DataFrame) -> DataFrame:
        workers_import(requests.sparkSession)
        kind = requests.schema["request_id"].dataType.simpleString()
        if folder is None:
            return requests.select("request_id", "query").mapInPandas(ask, f"request_id {kind}, output string, error string")
        keyed = requests.select("request_id", request_key(F.lit(task), F.col("query")).alias("key"), F.col("query").alias("payload"))
        answers = call_once(keyed, asked, folder, width, attempts)
        return keyed.join(answers, "key").select("request_id", "output", "error", "attempts")

    return plan


def updates_of(model: Model, registry: Registry, most_rounds: int = 10) -> Callable[[list[dict], str], Iterator[tuple]]:
    """What answers one message: from (history, message) to (type, content, tool_name) for each update.

    The model sees the history, the message, and each call's result; it replies with a JSON object {"tool", "input",
    "parameters"} for a call, and any other reply is the answer. Updates are tool_selected and tool_result for each call,
    assistant_message, and conversation_complete, or error where the model fails or does not answer within most_rounds.
    """
    listing = "Tools: " + ", ".join(sorted(registry.tools)) + '. Call one by replying {"tool": name, "input": text, "parameters": {}}; else answer.'

    def call_of(reply: str) -> dict | None:
        try:
            got = json.loads(reply)
        except (TypeError, ValueError):
            return None
        return got if isinstance(got, dict) and "tool" in got else None

    def updates(history: list[dict], message: str) -> Iterator[tuple]:
        said = [{"role": "system", "content": listing}, *history, {"role": "user", "content": message}]
        try:
            for _ in range(most_rounds):
                reply = model(said)
                call = call_of(reply)
                if call is None:
                    yield "assistant_message", reply, None
                    yield "conversation_complete", "completed", None
                    return
                name = str(call["tool"])
                yield "tool_selected", None, name
                done, output, error = registry.call(name, str(call.get("input", message)), dict(call.get("parameters") or {}))
                result = output if done else json.dumps({"error": error})
                yield "tool_result", result, name
                said += [{"role": "assistant", "content": reply}, {"role": "tool", "content": result}]
            yield "error", f"no answer within {most_rounds} rounds", None
        except Exception as e:
            yield "error", str(e), None

    return updates


def tool_agent(model: Model, registry: Registry, most_rounds: int = 10) -> Callable[[DataFrame], DataFrame]:
    """An agent for Service: answers each message by itself, as updates_of() does without a history.

    With a memory over a session's messages it is streaming.keyed.conversation(messages, updates_of(model, registry)).
    """
    updates = updates_of(model, registry, most_rounds)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = [(s, m, i + 1, *u) for s, m, text in f.itertuples(index=False, name=None) for i, u in enumerate(updates([], text))]
            yield pd.DataFrame(rows, columns=["session_id", "message_ord", "ord", "type", "content", "tool_name"])

    def agent(messages: DataFrame) -> DataFrame:
        workers_import(messages.sparkSession)
        return messages.select("session_id", "message_ord", "message").mapInPandas(run, UPDATES)

    return agent


async def call_async(registry: Registry, name: str, value: str, parameters: dict) -> tuple[bool, str | None, str | None]:
    """registry.call() that does not hold up the caller's event loop."""
    return await asyncio.to_thread(registry.call, name, value, parameters)
