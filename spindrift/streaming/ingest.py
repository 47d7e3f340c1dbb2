"""Incremental ingest: new files of a folder of JSONL logs, as messages and as turns, appended to a table as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.conversation import CONTEXT

_TURN = "id string, session_id string, user_input string, agent_response string, conversation_context string"


def messages(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (conversation_id, role, content, timestamp) of the lines that are messages; other lines are left out."""
    v = F.try_parse_json("value")
    get = lambda path: F.try_variant_get(v, path, "string")
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    out = rows.select(F.coalesce(get("$.conversation_id"), get("$.metadata.session_id")).alias("conversation_id"), get("$.role").alias("role"), get("$.content").alias("content"), F.try_to_timestamp(get("$.timestamp")).alias("timestamp"))
    return out.where("conversation_id is not null and role is not null and coalesce(content, '') <> ''")


def turns(stream: DataFrame, conversation: str = "conversation_id", order: str = "timestamp", role: str = "role", content: str = "content", forget: str | None = None) -> DataFrame:
    """A stream of one record per assistant message, as conversation.normalize_messages gives for the whole log.

    The state of a session is its number of answers, its last 20 entries and those since the last answer. Within a batch,
    messages are taken by `order`, a timestamp or number; one that isn't above the last that its session has seen is late and
    left out. forget: a session's state goes when the watermark of `order` (a timestamp) is this far past its last
    message, as "2 hours"; a later message then begins the session anew.
    """
    late = forget is not None
    kept = stream.where(F.col(conversation).isNotNull() & (F.col(conversation).cast("string") != "") & F.col(role).isin("user", "assistant") & (F.coalesce(F.col(content), F.lit("")) != "") & F.col(order).isNotNull())
    rows = kept.select(F.col(conversation).cast("string").alias("session_id"), F.col(order).alias("at"), (F.col(role) == "assistant").alias("answer"), F.col(content).alias("said"))
    wait = int(pd.Timedelta(forget).total_seconds() * 1000) if late else 0
    if late:
        rows = rows.withWatermark("at", "0 seconds")

    def follow(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, last, entries = state.get if state.exists else (0, "", [])
        entries, out = list(entries), []
        batch = pd.concat(list(parts)).sort_values("at", kind="stable")
        before = None if not last else (pd.Timestamp(last) if late or "datetime" in str(batch["at"].dtype) else float(last))
        for at, answer, said in zip(batch["at"], batch["answer"], batch["said"], strict=True):
            if before is not None and at <= before:
                continue
            before = at
            if answer:
                asked = next((e[len("User: ") :] for e in reversed(entries) if e.startswith("User: ")), "")
                out.append((f"{key[0]}_turn_{number}", key[0], asked, said, "\n".join(entries)))
                entries, number = [*entries, f"Assistant: {said}"][-CONTEXT:], number + 1
            else:
                entries.append(f"User: {said}")
        state.update((number, "" if before is None else str(before), entries))
        if late and before is not None:
            state.setTimeoutTimestamp(max(int(before.timestamp() * 1000) + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "session_id", "user_input", "agent_response", "conversation_context"], dtype=str)

    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return rows.groupBy("session_id").applyInPandasWithState(follow, _TURN, "number long, last string, entries array<string>", "append", timeout)


def append(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what is new and stop; a rerun goes on after the last committed batch."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
