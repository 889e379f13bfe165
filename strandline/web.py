"""The service over HTTP, with the standard library: JSON calls, server-sent events, and a folder of static pages.

Web.respond() turns one request into a reply and touches no socket; serve() puts it behind a server. Each call is a small
Spark query of the service. The agent is asked once for each message; a session keeps here how many messages it sent, the
tools that were selected for it, all of them, and its newest ``STREAM_CAP`` answers, which a stream is opened with.
"""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.api import Service
from strandline.operators.events import CHAT_CAP, STREAM_CAP
from strandline.plans import graph
from strandline.sources import pipelines

INCOMING = "session_id string, ord long, type string, message string, item string, approved boolean, comments string, greeted boolean"
MEDIA = {".html": "text/html", ".js": "text/javascript", ".css": "text/css", ".svg": "image/svg+xml", ".png": "image/png", ".json": "application/json"}


@dataclass
class Reply:
    status: int
    body: bytes
    media: str = "application/json"


def as_json(value, status: int = 200) -> Reply:
    return Reply(status, json.dumps(value, ensure_ascii=False).encode())


def as_stream(payloads: Iterable[dict]) -> Reply:
    return Reply(200, "".join(f"data: {json.dumps(p, ensure_ascii=False)}\n\n" for p in payloads).encode(), "text/event-stream")


@dataclass
class Session:
    """events: how many it sent; greeted: whether its first message has been answered; tools: names in order of selection."""

    events: int = 0
    greeted: bool = False
    tools: list[str] = field(default_factory=list)
    answers: deque = field(default_factory=lambda: deque(maxlen=STREAM_CAP))


@dataclass
class Web:
    """service: what answers; static: a folder with index.html and assets/, if there are pages."""

    service: Service
    static: str | None = None
    sessions: dict[str, Session] = field(default_factory=dict)

    def respond(self, method: str, target: str, body: bytes = b"") -> Reply:
        parts = urlsplit(target)
        for verb, pattern, handler in self._routes():
            found = re.fullmatch(pattern, parts.path)
            if found and verb == method:
                try:
                    given = json.loads(body) if body else {}
                    return handler(*map(unquote, found.groups()), query=parse_qs(parts.query), body=given)
                except (ValueError, TypeError, AttributeError) as e:
                    return as_json({"error": str(e)}, 400)
                except Exception as e:  # a failing call is a reply, not the server's end
                    return as_json({"error": str(e)}, 500)
        return as_json({"error": "Not found"}, 404)

    def _routes(self):
        return (
            ("GET", "/(?:visualizer|chat)?", self._page),
            ("GET", "/assets/(.+)", self._asset),
            ("GET", "/api/tools", self._tools),
            ("GET", "/api/pipelines", self._pipelines),
            ("GET", "/api/pipeline/([^/]+)", self._pipeline),
            ("POST", "/api/agui/session/([^/]+)/welcome", self._welcome),
            ("POST", "/api/agui/events", self._events),
            ("GET", "/api/agui/stream/([^/]+)", self._stream),
            ("POST", "/api/chat/stream", self._chat_stream),
            ("POST", "/api/chat/message", self._chat_message),
            ("GET", "/api/chat/pipeline/([^/]+)", self._session_pipeline),
            ("GET", "/api/chat/export/([^/]+)", self._export),
            ("GET", "/api/health", self._health),
        )

    # ---- pages

    def _file(self, name: str) -> Reply:
        root = Path(self.static or ".").resolve()
        path = (root / name).resolve()
        if not self.static or root not in path.parents or not path.is_file():
            return as_json({"error": "Not found"}, 404)
        return Reply(200, path.read_bytes(), MEDIA.get(path.suffix, "application/octet-stream"))

    def _page(self, query, body) -> Reply:
        return self._file("index.html")

    def _asset(self, name: str, query, body) -> Reply:
        return self._file(f"assets/{name}")

    # ---- tools and pipelines

    def _tools(self, query, body) -> Reply:
        return as_json({r["app_name"]: r["description"] for r in self.service.tools().orderBy("ord").collect()})  # of the catalog's size

    def _pipelines(self, query, body) -> Reply:
        return as_json([r["name"] for r in self.service.list_pipelines().collect()])

    def _pipeline(self, name: str, query, body) -> Reply:
        try:
            return as_json(pipelines.as_mapping(self.service.pipeline(name).first()))
        except FileNotFoundError:
            return as_json({"error": f"Pipeline '{name}' not found"}, 404)

    # ---- events and chats

    def _incoming(self, session: str, kind: str, message: str | None = None, item: str | None = None, approved: bool | None = None, comments: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The new event as a row, and what the agent says to it, which it is asked for here and not again."""
        own = self.sessions.setdefault(session, Session())
        own.events += 1
        new = self.service.spark.createDataFrame([(session, own.events, kind, message, item, approved, comments, own.greeted)], INCOMING)
        made = self.service.updates(new)
        rows = made.collect()  # what one message is answered by
        own.greeted = own.greeted or (kind == "user_message" and bool(message))
        own.tools += [r["tool_name"] for r in sorted(rows, key=lambda r: (r["message_ord"], r["ord"])) if r["type"] == "tool_selected" and r["tool_name"]]
        return new, self.service.spark.createDataFrame(rows, made.schema)

    def _answers(self, session: str, incoming: DataFrame, updates: DataFrame) -> list[dict]:
        rows = self.service.stream(incoming, updates=updates).orderBy("ord", "seq").collect()  # STREAM_CAP rows at most
        events = [{"type": r["type"], "data": {"content": r["content"]}, "session_id": r["session_id"], "timestamp": time.time()} for r in rows]
        self.sessions[session].answers.extend(events)
        return events

    def _welcome(self, session: str, query, body) -> Reply:
        events = self._answers(session, *self._incoming(session, "session_start"))
        return as_json({"status": "welcome_sent", "events_generated": len(events), "message": "Welcome message delivered"})

    def _events(self, query, body) -> Reply:
        data, session = body.get("data") or {}, body.get("session_id", "unknown")
        events = self._answers(session, *self._incoming(session, body.get("type"), data.get("message"), data.get("item"), data.get("approved"), data.get("comments")))
        return as_json({"status": "processed", "events_generated": len(events), "message": "Event processed successfully", "events": events})

    def _stream(self, session: str, query, body) -> Reply:
        opened = {"type": "connection_established", "data": {}, "session_id": session, "timestamp": time.time()}
        return as_stream([opened, *(self.sessions[session].answers if session in self.sessions else ())][:STREAM_CAP])

    def _chat_stream(self, query, body) -> Reply:
        if not body.get("message"):
            return as_json({"error": "Message is required"}, 400)
        session = body.get("session_id", "default")
        incoming, updates = self._incoming(session, "user_message", body["message"])
        self._answers(session, incoming, updates)
        rows = updates.orderBy("message_ord", "ord").limit(CHAT_CAP).collect()
        return as_stream({"type": r["type"], "content": {"content": r["content"], "tool_name": r["tool_name"]}, "timestamp": time.time()} for r in rows)

    def _chat_message(self, query, body) -> Reply:
        if not body.get("message"):
            return as_json({"error": "Message is required"}, 400)
        session = body.get("session_id", "default")
        incoming, updates = self._incoming(session, "user_message", body["message"])
        self._answers(session, incoming, updates)
        r = self.service.chat(incoming, updates).first()
        return as_json({"response": r["content"] if r else "", "tool_calls": r["tool_calls"] if r else [], "session_id": session, "tool_added": bool(r and r["tool_added"])})

    def _built(self, session: str) -> dict | None:
        """The pipeline that a session's messages have built, a node for each tool that was selected, or None."""
        rows = [(session, i, "tool_selected", t) for i, t in enumerate(self.sessions[session].tools)]
        chosen = self.service.spark.createDataFrame(rows, "session_id string, ord long, type string, tool_name string")
        nodes = graph.from_tool_events(chosen).withColumn("data", F.lit("{}"))
        edges = self.service.spark.createDataFrame([], "pipeline string, ord long, id string, source string, target string")
        row = graph.to_struct(nodes.select("pipeline").distinct(), nodes, edges).first()
        return pipelines.as_mapping(row) if row else None

    def _session_pipeline(self, session: str, query, body) -> Reply:
        if session not in self.sessions:
            return as_json({"error": "Session not found"}, 404)
        built = self._built(session)
        return as_json(built) if built else as_json({"error": "No pipeline found for session"}, 404)

    def _export(self, session: str, query, body) -> Reply:
        built = self._built(session) if session in self.sessions else None
        if not built:
            return as_json({"error": "No pipeline found for session"}, 404)
        built["name"] = query.get("name", [built["name"]])[0]
        return as_json({"yaml": pipelines.dump(built), "name": built["name"], "session_id": session})

    def _health(self, query, body) -> Reply:
        return as_json(self.service.health().first().asDict() | {"agent_available": self.service.agent is not None})


def serve(web: Web, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is bound but not running yet: call serve_forever(), or run that in a thread. Port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            reply = web.respond(self.command, self.path, self.rfile.read(size) if size else b"")
            self.send_response(reply.status)
            self.send_header("Content-Type", reply.media)
            self.send_header("Content-Length", str(len(reply.body)))
            if reply.media == "text/event-stream":
                self.send_header("Cache-Control", "no-cache")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(reply.body)

        do_GET = do_POST = _reply

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
