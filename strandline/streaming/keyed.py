"""Keyed state that lives across batches and restarts: a session's memory, a conversation with an agent, delivery to the
connection that is open, and caps.

All four are stateful processors over RocksDB, so a session's state is read and written alone, need not fit in memory with
the others, and is restored from the checkpoint. A batch that is run again starts from the state before it. Rows of one session
that arrive in one batch are put in order first, so what is held at once is a session's share of a batch.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from strandline.session import workers_import

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY = "ord long, role string, text string"
REMEMBERED = "session_id string, ord long, role string, text string, first boolean, history array<struct<ord:long,role:string,text:string>>"
UPDATES = "session_id string, message_ord long, ord long, type string, content string, tool_name string"
DELIVERED = "session_id string, seq long, queue string"


def keyed_state(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB, which stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    workers_import(spark)


def _place(entry: tuple) -> int:
    return entry[0]


class _History:
    """A session's entries in order of ord, as list state. An entry that is there already is not entered again."""

    def __init__(self, handle, ttl_ms: int | None) -> None:
        self.state = handle.getListState("history", ENTRY, ttl_ms)
        self.entries: list[tuple] = []

    def load(self) -> None:
        self.entries = sorted((tuple(e) for e in self.state.get()), key=_place)

    def before(self, place: int) -> list[tuple]:
        return self.entries[: bisect_left(self.entries, place, key=_place)]

    def knows(self, place: int) -> bool:
        at = bisect_left(self.entries, place, key=_place)
        return at < len(self.entries) and self.entries[at][0] == place

    def add(self, *new: tuple) -> None:
        self.state.appendList(list(new))
        for entry in new:
            insort(self.entries, entry, key=_place)


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: r["ord"])


class _Memory(StatefulProcessor):
    """Gives each entry of the asked roles with the entries before it."""

    def __init__(self, roles: tuple[str, ...], ttl_ms: int | None, idle_ms: int | None) -> None:
        self.roles, self.ttl_ms, self.idle_ms = roles, ttl_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.history = _History(handle, self.ttl_ms)
        self.counts = handle.getValueState("counts", "users long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.history.load()
        users = self.counts.get()[0] if self.counts.exists() else 0
        for r in _in_order(rows):
            if self.history.knows(r["ord"]):
                continue
            if r["role"] in self.roles:
                past = self.history.before(r["ord"])
                yield Row(session_id=key[0], ord=r["ord"], role=r["role"], text=r["text"], first=users == 0 and r["role"] == "user", history=[Row(ord=o, role=w, text=t) for o, w, t in past])
            users += r["role"] == "user"
            self.history.add((r["ord"], r["role"], r["text"]))
        self.counts.update((users,))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.history.state.clear()
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def remembered(events: DataFrame, roles: tuple[str, ...] = ("user",), ttl_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Each event of the roles with its session's history before it, whatever batch that came in: REMEMBERED rows.

    events: session_id, ord, role, text, as a stream. An ord that a session has had already is a repetition and gives no row.
    ``first`` is true for a session's first user message, which is when a welcome is due. Entries expire ``ttl_ms`` after they
    came; a session that has had no event for ``idle_ms`` is forgotten as a whole. None keeps them.
    """
    keyed_state(events.sparkSession)
    rows = events.select(F.col("session_id").cast("string").alias("session_id"), F.col("ord").cast("long").alias("ord"), "role", "text")
    mode = "None" if ttl_ms is None and idle_ms is None else "ProcessingTime"
    return rows.groupBy("session_id").transformWithState(_Memory(roles, ttl_ms, idle_ms), REMEMBERED, "Append", mode)


class _Conversation(StatefulProcessor):
    """Answers each message with an agent that is given what the session has said so far, its own answers among it."""

    def __init__(self, answer: Callable[[list[dict], str], Iterator[tuple]], ttl_ms: int | None) -> None:
        self.answer, self.ttl_ms = answer, ttl_ms

    def init(self, handle) -> None:
        self.history = _History(handle, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.history.load()
        for r in _in_order(rows):
            place = 2 * r["ord"]  # the answer's place is the odd one after it
            if self.history.knows(place):
                continue
            said = [{"role": role, "content": text} for _, role, text in self.history.before(place)]
            last = None
            for i, (kind, content, tool) in enumerate(self.answer(said, r["text"])):
                last = content if kind == "assistant_message" else last
                yield Row(session_id=key[0], message_ord=r["ord"], ord=i + 1, type=kind, content=content, tool_name=tool)
            self.history.add((place, "user", r["text"]), *([] if last is None else [(place + 1, "assistant", last)]))

    def close(self) -> None:
        pass


def conversation(messages: DataFrame, answer: Callable[[list[dict], str], Iterator[tuple]], ttl_ms: int | None = None) -> DataFrame:
    """UPDATES rows of an agent with a memory. messages: session_id, ord, text, as a stream.

    answer(history, message) gives (type, content, tool_name) for each update; plans.agents.updates_of() makes one from a model and
    a registry. history is a list of dicts of role and content: the session's earlier messages and last answers. A message
    without an answer stays in it. Calls are made once for each batch that is committed; a batch that fails makes them again.
    """
    keyed_state(messages.sparkSession)
    rows = messages.select(F.col("session_id").cast("string").alias("session_id"), F.col("ord").cast("long").alias("ord"), "text")
    return rows.groupBy("session_id").transformWithState(_Conversation(answer, ttl_ms), UPDATES, "Append", "None" if ttl_ms is None else "ProcessingTime")


def _ms(us: int) -> int:
    """When the watermark has passed a row's time."""
    return us // 1000 + 1


class _Delivery(StatefulProcessor):
    """Keeps a session's open connection; rows wait until the watermark has passed them and are then taken in order."""

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "queue string")
        self.waiting = handle.getListState("waiting", "us long, seq long, queue string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["us"], r["seq"], r["queue"]) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(_ms(max(us for us, *_ in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = [tuple(w) for w in self.waiting.get()]
        ripe = [w for w in waiting if _ms(w[0]) <= now]
        queue = self.open.get()[0] if self.open.exists() else None
        for _, seq, opened in sorted(ripe, key=lambda w: w[:2]):
            if opened is not None:
                queue = opened
            elif queue is not None:
                yield Row(session_id=key[0], seq=seq, queue=queue)
        if queue is not None:
            self.open.update((queue,))
        self.waiting.clear()
        if later := [w for w in waiting if _ms(w[0]) > now]:
            self.waiting.put(later)

    def close(self) -> None:
        pass


def deliver(events: DataFrame, connections: DataFrame, late: str = "1 minute") -> DataFrame:
    """(session_id, seq, queue): each event with the queue of its session's latest connection at the event's time. Both are streams.

    events: session_id, at, seq; connections: session_id, at, seq, queue. seq orders rows of one time. Rows wait until the
    watermark, ``late`` behind the newest row of either stream, has passed them, so a connection that arrives after events it
    precedes still gets them and replaces the one before from its own time on. Events before a session's first connection are lost;
    so is what arrives later than ``late``, rows without a time and connections without a queue. Times are compared as microseconds
    since 1970, whatever the time zones of session and workers.
    """
    keyed_state(events.sparkSession)
    key, seq = F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq")
    opened = connections.filter("queue IS NOT NULL").select(key, "at", seq, F.col("queue").cast("string").alias("queue"))
    both = events.select(key, "at", seq, F.lit(None).cast("string").alias("queue")).unionByName(opened).filter("at IS NOT NULL").withColumn("us", F.unix_micros("at"))
    return both.withWatermark("at", late).groupBy("session_id").transformWithState(_Delivery(), DELIVERED, "Append", "EventTime")


class _Cap(StatefulProcessor):
    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle) -> None:
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.n.get()[0] if self.n.exists() else 0
        if n >= self.most:
            return
        for r in _in_order(rows)[: self.most - n]:
            n += 1
            yield Row(session_id=key[0], ord=r["ord"], frame=r["frame"])
        self.n.update((n,))

    def close(self) -> None:
        pass


def capped_stream(frames: DataFrame, most: int) -> DataFrame:
    """The first ``most`` frames of each session (session_id, ord, frame), counted across batches; a batch's rows go by ord."""
    keyed_state(frames.sparkSession)
    rows = frames.select(F.col("session_id").cast("string").alias("session_id"), F.col("ord").cast("long").alias("ord"), "frame")
    return rows.groupBy("session_id").transformWithState(_Cap(most), "session_id string, ord long, frame string", "Append", "None")
