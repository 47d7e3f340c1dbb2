"""Conversation turns: ordered history frames, composed texts, and message logs as turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions.text import js_string
from .table import with_running_sum

FRAMES = ("turn_only", "history_until_turn", "turn_plus_n", "full_conversation")
CONTEXT = 20


def frame(w: WindowSpec, strategy: str, n: int = 3) -> WindowSpec:
    low, high = {"turn_only": (0, 0), "history_until_turn": (W.unboundedPreceding, 0), "turn_plus_n": (1 - n, 0), "full_conversation": (W.unboundedPreceding, W.unboundedFollowing)}[strategy]
    return w.rowsBetween(low, high)


def sequence_key(column: Column) -> list[Column]:
    """Order of sequence values: numbers by value, other texts after them in locale order."""
    number = column.cast("string").try_cast("double")
    return [number.asc_nulls_last(), F.collate(column.cast("string"), "UNICODE").asc_nulls_last()]


def turn_lines(df: DataFrame, columns: Sequence[str]) -> Column:
    """name: value lines of a row; null values are empty."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(js_string(F.col(c), kinds[c]), F.lit(""))) for c in columns])


def history(df: DataFrame, conversation: str, order: Sequence[str | Column], columns: Sequence[str], strategy: str = "history_until_turn", n: int = 3, out: str = "history") -> DataFrame:
    """df with each turn's history by the strategy; null and empty conversation ids are one group.

    A frame that is not cut and ends with the turn itself marks it as current.
    """
    group = F.coalesce(F.col(conversation).cast("string"), F.lit(""))
    w = W.partitionBy(group).orderBy(*order)
    rows = df.withColumn("__lines", turn_lines(df, columns)).withColumn("__i", F.row_number().over(w) - 1)
    rows = rows.withColumn("__frame", F.collect_list("__lines").over(frame(w, strategy, n)))

    def shown(line: Column, k: Column) -> Column:
        last = (k == F.size("__frame") - 1) & (k == F.col("__i"))
        return F.concat(F.lit("[Turn "), (k + 1).cast("string"), F.lit("]"), F.when(last, F.lit(" ← CURRENT")).otherwise(F.lit("")), F.lit("\n"), line)

    return rows.withColumn(out, F.array_join(F.transform("__frame", shown), "\n---\n")).drop("__lines", "__i", "__frame")


def compose(df: DataFrame, conversation: str, order: Sequence[str | Column], columns: Sequence[str], strategy: str = "history_until_turn", n: int = 3, row_index: str = "row_index") -> DataFrame:
    """(point_no, label, composed_text, source_row_indices): one row a turn, or one a conversation for full_conversation.

    Rows without a conversation id are left out. Points are numbered by each conversation's first row, then by turn.
    """
    rows = df.where(F.col(conversation).isNotNull() & (F.col(conversation).cast("string") != "")).withColumn("__lines", turn_lines(df, columns))
    first = F.min(row_index).over(W.partitionBy(conversation))
    w = W.partitionBy(conversation).orderBy(*order, row_index)
    rows = rows.select(F.col(conversation).cast("string").alias("label"), first.alias("__first"), F.row_number().over(w).alias("__turn"), *[F.collect_list(x).over(frame(w, strategy, n)).alias(y) for x, y in (("__lines", "__texts"), (row_index, "source_row_indices"))])
    if strategy == "full_conversation":
        rows = rows.where("__turn = 1")
    # A running number needs one order over all points; it is made of counts by conversation, not of the rows.
    sizes = with_running_sum(rows.groupBy("label", "__first").agg(F.count("*").alias("__n")), ["__first", "label"], "__n", "__points_before")
    numbered = rows.join(sizes.drop("__n"), ["label", "__first"])
    return numbered.select((F.col("__points_before") + F.col("__turn") - 1).alias("point_no"), "label", F.array_join("__texts", "\n---\n").alias("composed_text"), "source_row_indices")


def write_back(df: DataFrame, points: DataFrame, out: str = "composed_text", row_index: str = "row_index") -> DataFrame:
    """df with the composed text of the last point that each row is a source of."""
    texts = points.select("point_no", "composed_text", F.explode("source_row_indices").alias(row_index)).groupBy(row_index).agg(F.max_by("composed_text", "point_no").alias(out))
    return df.join(texts, row_index, "left")


def normalize_messages(df: DataFrame, conversation: str = "conversation_id", order: Sequence[str | Column] = ("line_no",), role: str = "role", content: str = "content") -> DataFrame:
    """One record per assistant message: id, session_id, user_input, agent_response, conversation_context.

    The context is a running transcript of user and assistant messages, cut to its last 20 entries after each answer.
    """
    kept = df.where(F.col(conversation).isNotNull() & (F.col(conversation).cast("string") != "") & F.col(role).isin("user", "assistant") & (F.coalesce(F.col(content), F.lit("")) != ""))
    session, answer = F.col(conversation).cast("string"), F.col(role) == "assistant"
    w = W.partitionBy("session_id").orderBy(*order)
    entry = F.concat(F.when(answer, F.lit("Assistant: ")).otherwise(F.lit("User: ")), F.col(content)).alias("entry")
    rows = kept.withColumn("session_id", session).select(
        "session_id",
        answer.alias("answer"),
        entry,
        F.row_number().over(w).alias("pos"),
        F.count_if(answer).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("turn"),
        F.collect_list(entry).over(w.rowsBetween(1 - CONTEXT, 0)).alias("tail"),
    )
    # What an answer has seen: the last entries up to the answer before, and all entries since. Each entry is gathered once.
    since = rows.where(~F.col("answer")).groupBy("session_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]).alias("since"))
    answers = rows.where("answer").withColumn("before", F.lag("tail").over(W.partitionBy("session_id").orderBy("turn"))).join(since, ["session_id", "turn"], "left")
    none = F.array().cast("array<string>")
    answers = answers.withColumn("context", F.concat(F.coalesce("before", none), F.coalesce("since", none)))
    asked = F.try_element_at(F.filter("context", lambda x: x.startswith("User: ")), F.lit(-1))
    return answers.select(
        F.concat("session_id", F.lit("_turn_"), F.col("turn").cast("string")).alias("id"),
        "session_id",
        F.coalesce(F.substring(asked, len("User: ") + 1, 2**31 - 1), F.lit("")).alias("user_input"),
        F.substring("entry", len("Assistant: ") + 1, 2**31 - 1).alias("agent_response"),
        F.array_join("context", "\n").alias("conversation_context"),
    )
