"""Agent records of every log format: id, timestamp, session_id, user_input, agent_response; validation and profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names under which turn-level tables have a field, in order of preference.
SYNONYMS = {
    "id": ["turn_id", "id", "turnId", "turn"],
    "timestamp": ["timestamp", "time", "created_at", "date"],
    "session_id": ["conversation_id", "session_id", "conversationId", "conv_id"],
    "user_input": ["user_message", "user_input", "input", "user", "question"],
    "agent_response": ["assistant_message", "assistant_text", "assistant_response", "response", "output", "answer"],
    "agent_reasoning": ["reasoning", "rationale", "explanation", "thinking"],
    "conversation_context": ["conversation_context", "context", "history"],
}
# Columns of turn-level tables that are never metadata.
CORE = ["id", "turn_id", "timestamp", "conversation_id", "session_id", "user_message", "user_input", "assistant_text", "agent_response", "reasoning", "agent_reasoning", "conversation_context"]
FIELDS = tuple(SYNONYMS)
NO_METADATA = "map<string,string>"


def _text(path: str, c: str = "v") -> Column:
    return F.nullif(F.try_variant_get(c, path, "string"), F.lit(""))


def _last_message(path: str, role: str, role_key: str = "role", content_key: str = "content", c: str = "v") -> Column:
    """The content of the last message of a role in an array of messages."""
    found = F.filter(F.try_variant_get(c, path, "array<variant>"), lambda m: F.coalesce(F.try_variant_get(m, f"$['{role_key}']", "string") == role, F.lit(False)))
    return F.try_variant_get(F.try_element_at(found, F.lit(-1)), f"$['{content_key}']", "string")


def _shown(x: Column) -> Column:
    """A VARIANT as text: strings as they are, all else as JSON."""
    return F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))


def _object(path: str, c: str = "v") -> Column:
    """An object's fields as texts; those that are null are left out."""
    found = F.try_variant_get(c, path, "map<string,variant>")
    texts = F.transform_values(found, lambda _, x: _shown(x))
    return F.coalesce(F.map_filter(texts, lambda _, x: x.isNotNull()), F.create_map().cast(NO_METADATA))


def _json(path: str, c: str = "v") -> Column:
    return F.to_json(F.try_variant_get(c, path, "variant"))


def _merged(*maps: Column) -> Column:
    """One map of several; of equal keys the last one's value."""

    def over(first: Column, then: Column) -> Column:
        return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(then, k)), then)

    return reduce(over, maps)


def _named(c: str, **paths: str) -> Column:
    """The values at some paths by name; missing ones are left out."""
    cells = [x for name, path in paths.items() for x in (F.lit(name), _shown(F.try_variant_get(c, path, "variant")))]
    return F.map_filter(F.create_map(*cells), lambda _, x: x.isNotNull())


def _whole(df: DataFrame) -> DataFrame:
    """Records that have both sides."""
    return df.where("user_input <> '' and agent_response <> ''")


def langfuse(rows: DataFrame) -> DataFrame:
    """Generations, and observations with llm in their name, of traces (v)."""
    x = rows.select("v", F.explode(F.try_variant_get("v", "$.observations", "array<variant>")).alias("o"))
    model = F.coalesce(F.try_variant_get("o", "$.type", "string") == "GENERATION", F.lit(False)) | F.coalesce(F.lower(F.try_variant_get("o", "$.name", "string")).contains("llm"), F.lit(False))
    return _whole(
        x.where(model).select(
            F.concat_ws("_obs_", _text("$.id"), _text("$.id", "o")).alias("id"),
            F.coalesce(_text("$.start_time", "o"), _text("$.timestamp")).alias("timestamp"),
            F.coalesce(_text("$.session_id"), _text("$.id")).alias("session_id"),
            F.coalesce(_last_message("$.input.messages", "user", c="o"), _text("$.input.input", "o"), _text("$.input", "o"), F.lit("")).alias("user_input"),
            F.coalesce(_text("$.output.content", "o"), _text("$.output.output", "o"), _text("$.output", "o"), F.lit("")).alias("agent_response"),
            _text("$.metadata.reasoning", "o").alias("agent_reasoning"),
            _json("$.input", "o").alias("conversation_context"),
            _merged(
                _object("$.metadata", "o"),
                _object("$.metadata"),
                _named("o", observation_name="$.name", observation_id="$.id", model="$.model", usage="$.usage", cost="$.calculated_total_cost"),
            ).alias("metadata"),
        )
    )


def langsmith(rows: DataFrame) -> DataFrame:
    """Runs (v) with an input and an output; a run without a start time has no timestamp."""
    return _whole(
        rows.select(
            _text("$.id").alias("id"),
            _text("$.start_time").alias("timestamp"),
            F.coalesce(_text("$.session_id"), _text("$.trace_id")).alias("session_id"),
            F.coalesce(_text("$.inputs.input"), _last_message("$.inputs.messages", "user"), F.lit("")).alias("user_input"),
            F.coalesce(_text("$.outputs.text"), _text("$.outputs.generations[0].text"), _text("$.outputs.output"), _text("$.outputs.content"), F.lit("")).alias("agent_response"),
            _text("$.extra.reasoning").alias("agent_reasoning"),
            _json("$.inputs").alias("conversation_context"),
            _merged(
                _object("$.extra"),
                _named("v", **{n: f"$.{n}" for n in ("name", "run_type", "parent_run_id", "execution_order", "status", "total_tokens", "total_cost")}),
            ).alias("metadata"),
        )
    )


def arize(rows: DataFrame) -> DataFrame:
    """Spans (v) with an input and an output; a span without a start time has no timestamp."""
    trace, attribute = _text("$['context.trace_id']"), "$.attributes['{}']".format
    usage = F.to_json(F.struct(*[F.try_variant_get("v", attribute(f"llm.token_count.{n}"), "variant").alias(n) for n in ("prompt", "completion", "total")]))
    return _whole(
        rows.select(
            F.concat_ws("_", trace, _text("$['context.span_id']")).alias("id"),
            _text("$.start_time").alias("timestamp"),
            F.coalesce(_text(attribute("session.id")), trace).alias("session_id"),
            F.coalesce(_text(attribute("input.value")), _last_message(attribute("llm.input_messages"), "user", "message.role", "message.content"), F.lit("")).alias("user_input"),
            F.coalesce(_text(attribute("output.value")), _last_message(attribute("llm.output_messages"), "assistant", "message.role", "message.content"), F.lit("")).alias("agent_response"),
            _text("$.attributes.metadata.reasoning").alias("agent_reasoning"),
            F.coalesce(_text(attribute("input.value")), F.lit("")).alias("conversation_context"),
            _merged(
                _object("$.attributes.metadata"),
                _named("v", span_name="$.name", span_kind="$.kind", model=attribute("llm.model_name"), user_id=attribute("user.id"), service="$.resource.attributes['service.name']", status="$.status_code"),
                F.create_map(F.lit("token_usage"), usage),
            ).alias("metadata"),
        )
    )


def turn_level(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Turns with both sides, by a mapping of fields to columns, else by the columns' names; other columns go to a metadata map."""
    chosen = {f: (mapping or {}).get(f) or next((s for s in SYNONYMS[f] if s in df.columns), None) for f in FIELDS}
    rest = [c for c in df.columns if c not in CORE and c not in (mapping or {}).values()]
    metadata = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[F.col(f"`{c}`").cast("string") for c in rest])), lambda _, v: v.isNotNull() & (v != "")) if rest else F.create_map().cast(NO_METADATA)
    return _whole(df.select(*[(F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")).alias(f) for f, c in chosen.items()], metadata.alias("metadata")))


def errors(df: DataFrame) -> DataFrame:
    """df with an array of validation errors: missing id, user_input or agent_response, unreadable timestamp."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    stamp = F.col("timestamp")
    checks = [
        F.when(F.coalesce("id", F.lit("")) == "", F.lit("id")),
        F.when(blank("user_input"), F.lit("user_input")),
        F.when(blank("agent_response"), F.lit("agent_response")),
        F.when((F.coalesce(stamp, F.lit("")) != "") & F.try_to_timestamp(stamp).isNull(), F.lit("timestamp")),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def upload_stats(df: DataFrame) -> DataFrame:
    """Valid rows, invalid rows, errors, and ids that repeat among the valid rows."""
    x = errors(df)
    ok = F.size("errors") == 0
    return x.agg(F.count_if(ok).alias("valid_rows"), F.count_if(~ok).alias("invalid_rows"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("error_count"), (F.count(F.when(ok, F.col("id"))) - F.countDistinct(F.when(ok, F.col("id")))).alias("duplicate_ids"))


def profile(df: DataFrame, fields: Sequence[str], rows: int = 10, samples: int = 3) -> DataFrame:
    """(field, type, samples) over the first rows: date, number, boolean, json or string."""
    head = df.limit(rows)
    long = head.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f).cast("string") for f in fields]))).alias("field", "value")).where("value is not null")
    v = F.col("value")
    kind = F.when(v.rlike(r"^\s*[\[{]") & F.try_parse_json(v).isNotNull(), "json").when(v.isin("true", "false"), "boolean").when(v.try_cast("double").isNotNull(), "number").when(F.try_to_timestamp(v).isNotNull(), "date").otherwise("string")
    return long.withColumn("kind", kind).groupBy("field").agg(F.mode("kind", True).alias("type"), F.slice(F.array_sort(F.collect_set("value")), 1, samples).alias("samples"))
