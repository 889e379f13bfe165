"""Per-session state, in batch and as a stream.

Both forms fold events (session_id, ord, role, text) into one row per session: number of messages, first and last
ordinal, last assistant text, whether a welcome was due. The fold is over values that combine (counts, least, greatest),
so the stream needs no history and its order does not matter; state expires after a time to live.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "session_id string, messages long, user_messages long, first_ord long, last_ord long, last_text string, welcomed boolean"


def session_states(events: DataFrame) -> DataFrame:
    """The batch form."""
    text = F.when(F.col("role") == "assistant", F.struct("ord", "text"))
    users = F.count_if(F.col("role") == "user")
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"), users.alias("user_messages"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.max(text)["text"].alias("last_text"), (users > 0).alias("welcomed")
    )


def session_stream(events: DataFrame, ttl_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """The streaming form: update rows of a session's state after each batch in which it has events.

    State is one small row per session and is dropped when a session has had no event for the time to live. Without
    one (None) it stays, which suits a run over what is there: timeouts would keep such a run going.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    state_schema = "messages long, user_messages long, first_ord long, last_ord long, last_text string, text_ord long"

    def fold(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        messages, users, first, last, text, text_ord = state.get if state.exists else (0, 0, 1 << 62, -(1 << 62), None, -(1 << 62))
        for f in frames:
            messages += len(f)
            users += int((f["role"] == "user").sum())
            first, last = min(first, int(f["ord"].min())), max(last, int(f["ord"].max()))
            said = f[f["role"] == "assistant"]
            if len(said) and int(said["ord"].max()) > text_ord:
                at = said.loc[said["ord"].idxmax()]
                text, text_ord = at["text"], int(at["ord"])
        state.update((messages, users, first, last, text, text_ord))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(key[0], messages, users, first, last, text, users > 0)], columns=["session_id", "messages", "user_messages", "first_ord", "last_ord", "last_text", "welcomed"])

    return events.select("session_id", "ord", "role", "text").groupBy("session_id").applyInPandasWithState(fold, RESULT, state_schema, "update", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def heartbeat_stream(events: DataFrame, every_ms: int = 30_000) -> DataFrame:
    """A row (session_id, type 'heartbeat') for each ``every_ms`` of processing time in which a session had no event."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def beat(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        timed_out = state.hasTimedOut
        for _ in frames:
            pass
        state.update((1,))
        state.setTimeoutDuration(every_ms)
        if timed_out:
            yield pd.DataFrame([(key[0], "heartbeat")], columns=["session_id", "type"])

    return events.select("session_id").groupBy("session_id").applyInPandasWithState(beat, "session_id string, type string", "seen int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def fan_out(stream: DataFrame, connections: Callable[[], DataFrame], deliver: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that joins each batch of events with the connections at that time and hands the rows on.

    stream: session_id, at, ...; see lookups.latest_connection(). deliver(rows, batch_id) has to tolerate a batch twice.
    """
    from strandline.operators.lookups import latest_connection

    def each(batch: DataFrame, batch_id: int) -> None:
        deliver(latest_connection(batch, connections()), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def run_available(df: DataFrame, name: str, mode: str, checkpoint: str, timeout: int = 300) -> DataFrame:
    """Run a stream over what is there now and return its rows; an overlong run is stopped and raises.

    Rows are Parquet files beside the checkpoint, a folder for each batch, so a batch that is run twice counts once.
    """
    rows = f"{checkpoint.rstrip('/')}-rows"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={batch_id}")

    query = df.writeStream.outputMode(mode).queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"{name} ran longer than {timeout} s")
    if query.lastProgress is None:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.read.schema(df.schema).parquet(rows).select(*df.columns)


def call_with_timeout(spark: SparkSession, action: Callable[[], object], seconds: float, group: str) -> object:
    """The result of an action, or TimeoutError after that time; its Spark jobs are then cancelled, so no late result leaks."""
    from pyspark import InheritableThread


    box: dict[str, object] = {}

    def work() -> None:
        spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
        try:
            box["value"] = action()
        except Exception as e:
            box["error"] = e

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        raise TimeoutError(f"no result after {seconds} s")
    if "error" in box:
        raise box["error"]
    return box.get("value")
