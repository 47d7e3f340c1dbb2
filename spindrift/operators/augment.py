"""Model-backed columns: prompts per row, batched provider calls in tasks, failures as data, retries and expansion.

A provider is any picklable object with `complete(prompts) -> list` that gives, for each prompt, a string or an exception
(or raises for the whole batch). Live providers are the caller's; `EchoProvider` is a deterministic stand-in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import error_class
from ..functions.templates import Prompt
from ..functions.text import field, interpolate, lenient_json, schema_prompt, violations

CONCURRENCY = 5
EMBED_BATCH = 100
SUFFIX = " [truncated...]"

# Most tokens that an embedding model takes, and how much shorter other providers' limits are taken.
MODEL_MAX_TOKENS = {
    "text-embedding-3-small": 8191,
    "text-embedding-3-large": 8191,
    "text-embedding-ada-002": 8191,
    "embed-english-v3.0": 512,
    "embed-multilingual-v3.0": 512,
    "embed-english-light-v3.0": 512,
    "embed-multilingual-light-v3.0": 512,
    "text-embedding-004": 2048,
    "mistral-embed": 8192,
}
TOKENIZER_SCALE = {"openai": 1.0, "cohere": 0.9, "google": 0.85, "mistral": 0.95}


class Provider(Protocol):
    def complete(self, prompts: Sequence[str]) -> list[str | Exception]: ...


@dataclass(frozen=True)
class EchoProvider:
    """Answers with the length of the prompt, fails where the prompt has `fails` in it."""

    fails: str | None = None

    def complete(self, prompts: Sequence[str]) -> list[str | Exception]:
        return [RuntimeError("rate limit exceeded") if self.fails and self.fails in p else f"{len(p)} characters" for p in prompts]

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]


def answer(df: DataFrame, prompt: Column, provider: Provider, key: str = "row_index", batch: int = CONCURRENCY) -> DataFrame:
    """(key, content, error): one call a batch of rows, several batches of a task at a time; an error fails its rows only."""

    def one(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            found = provider.complete(prompts)
        except Exception as e:  # the whole batch failed
            found = [e] * len(prompts)
        return [(None, str(x)) if isinstance(x, Exception) else (x, None) for x in found]

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(CONCURRENCY) as pool:
            for part in parts:
                prompts = part["prompt"].tolist()
                found = [x for xs in pool.map(one, [prompts[i : i + batch] for i in range(0, len(prompts), batch)]) for x in xs]
                yield pd.DataFrame({key: part[key], "content": [c for c, _ in found], "error": [e for _, e in found]})

    asked = df.select(key, prompt.alias("prompt"))
    kind = dict(df.dtypes)[key]
    return asked.mapInPandas(apply, f"`{key}` {kind}, content string, error string")


def filled_prompts(df: DataFrame, prompt: Prompt, out: str = "prompt") -> DataFrame:
    """df with the prompt of a template document filled for each row; it is an error if a required variable has no column."""
    if not prompt.valid:
        raise ValueError(f"no column for {', '.join(v['name'] for v in prompt.unmapped)}")
    return df.withColumn(out, interpolate(prompt.text, df.schema))


def model_column(df: DataFrame, template: str, provider: Provider, key: str = "row_index", batch: int = CONCURRENCY) -> DataFrame:
    """(key, value, status, error, error_type) of each row; a failed cell has no value, its error is metadata."""
    out = answer(df, interpolate(template, df.schema), provider, key, batch)
    failed = F.col("error").isNotNull()
    return out.select(key, F.col("content").alias("value"), F.when(failed, "failed").otherwise("success").alias("status"), "error", F.when(failed, error_class(F.col("error"))).alias("error_type"))


def structured_column(df: DataFrame, template: str, schema: Sequence[Mapping], provider: Provider, key: str = "row_index", batch: int = CONCURRENCY) -> DataFrame:
    """(key, value, status, error, error_type): the prompt asks for JSON of the schema, the answer is its JSON text.

    An answer that holds no JSON, or JSON that the schema doesn't allow, is a failed cell without a value.
    """
    out = answer(df, F.concat(interpolate(template, df.schema), F.lit(schema_prompt(schema))), provider, key, batch)
    out = out.withColumn("json", F.to_json(lenient_json(F.col("content"))))
    wrong = F.array_join(violations(F.col("json"), schema), "; ")
    none = F.when(F.col("content").isNotNull() & F.col("json").isNull(), F.lit("no JSON in the answer"))
    out = out.withColumn("error", F.coalesce("error", none, F.nullif(wrong, F.lit(""))))
    failed = F.col("error").isNotNull()
    kind = F.when(F.col("content").isNotNull(), F.lit("invalid_request")).otherwise(error_class(F.col("error")))
    return out.select(key, F.when(~failed, F.col("json")).alias("value"), F.when(failed, "failed").otherwise("success").alias("status"), "error", F.when(failed, kind).alias("error_type"))


def corrections(rows: DataFrame, cells: DataFrame, column_id: str, k: int = 10, key: str = "row_index") -> DataFrame:
    """rows of the k cells of a column that were edited last, newest first, with `output`, the corrected value.

    cells holds (row_index, column_id, edited, value, last_edit_time).
    """
    edited = cells.where((F.col("column_id") == column_id) & F.coalesce(F.col("edited"), F.lit(False)))
    newest = edited.orderBy(F.col("last_edit_time").desc_nulls_last(), key).limit(k).select(key, F.col("value").alias("output"), "last_edit_time")
    return rows.join(newest, key).orderBy(F.col("last_edit_time").desc_nulls_last(), key)


def retry_rows(cells: DataFrame, scope: str) -> DataFrame:
    """Cells to be asked again: failed, failed-edited (failed or edited), or all."""
    failed, edited = F.col("status") == "failed", F.coalesce(F.col("edited"), F.lit(False))
    return cells.where({"failed": failed, "failed-edited": failed | edited, "all": F.lit(True)}[scope])


def retry(df: DataFrame, cells: DataFrame, template: str, provider: Provider, scope: str = "failed", key: str = "row_index") -> DataFrame:
    """cells (key, value, status, error, error_type, edited) with those of the scope asked again; retried cells aren't edited."""
    chosen = retry_rows(cells, scope).select(key)
    new = model_column(df.join(chosen, key, "left_semi"), template, provider, key).withColumn("edited", F.lit(False))
    return cells.join(new.select(key), key, "left_anti").select(*new.columns).union(new)


def edited_cells(edits: DataFrame, key: Sequence[str] = ("column_id", "row_index")) -> DataFrame:
    """Of a log (keys, before, after, at): the first value before, the last value after, and when."""
    return edits.groupBy(*key).agg(F.min_by("before", "at").alias("original_value"), F.max_by("after", "at").alias("value"), F.max("at").alias("last_edit_time"), F.lit(True).alias("edited"))


def expand_structured(df: DataFrame, column: str, schema: Sequence[Mapping], mode: str = "both") -> DataFrame:
    """Fields of a column of model answers as columns <column>_<field>; mode single, expanded or both."""
    if mode == "single":
        return df
    kind = lambda f: f["type"] if f["type"] in ("number", "boolean") else "string"
    json = F.to_json(lenient_json(F.col(column)))
    wide = df.withColumn("__json", json).withColumns({f"{column}_{f['name']}": field(F.col("__json"), f["name"], kind(f)) for f in schema}).drop("__json")
    return wide.drop(column) if mode == "expanded" else wide


def validated(df: DataFrame, column: str, schema: Sequence[Mapping], out: str = "violations") -> DataFrame:
    return df.withColumn(out, violations(F.to_json(lenient_json(F.col(column))), schema))


def seeded_sample(df: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """k rows without replacement, by a seeded hash: the same for the same rows."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k)


def few_shot_prompt(examples: Sequence[Mapping], most_fields: int = 5, most_chars: int = 200) -> str:
    """A prefix of corrected examples, newest first; a handful of rows that the caller has chosen."""
    blocks = []
    for i, row in enumerate(examples, 1):
        shown = {k: v for k, v in row.items() if k not in ("row_index", "output") and not k.endswith("__meta")}
        lines = [f"{k}: {str(v)[:most_chars]}" for k, v in list(shown.items())[:most_fields]]
        blocks.append("\n".join([f"Example {i}:", *lines, f"Output: {row['output']}"]))
    return "\n\n".join(blocks) + ("\n\n" if blocks else "")


def truncated(text: Column, count, most: int) -> Column:
    """Texts of more than `most` tokens cut to the longest prefix that fits with a suffix; `count` is a tokenizer's
    picklable text -> number of tokens."""

    def cut(x: str) -> str:
        if count(x) <= most:
            return x
        low, high, room = 0, len(x), most - count(SUFFIX)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if count(x[:mid]) <= room else (low, mid - 1)
        return x[:low] + SUFFIX

    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else cut(x))

    return F.pandas_udf(apply, "string")(text)


def truncated_at(text: Column, starts: Callable[[str], Sequence[int]], most: int) -> Column:
    """Texts of more than `most` tokens cut before the first token that doesn't fit with a suffix, by one tokenization each.

    starts is a tokenizer's picklable text -> offsets at which its tokens start. The result is that of `truncated` wherever a
    prefix that ends before a token has the tokens before it.
    """

    def apply(s: pd.Series) -> pd.Series:
        room = max(0, most - len(starts(SUFFIX)))

        def cut(x: str | None) -> str | None:
            found = [] if x is None else starts(x)
            return x if len(found) <= most else x[: found[room]] + SUFFIX

        return s.map(cut)

    return F.pandas_udf(apply, "string")(text)


def token_limit(model: str, provider: str) -> int:
    return int(MODEL_MAX_TOKENS.get(model, 8000) * TOKENIZER_SCALE.get(provider.lower(), 0.8))


# The length of the vectors that an embedding model gives, and of all others.
DIMENSIONS = {
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-ada-002": 1536,
    "embed-english-v3.0": 1024,
    "embed-multilingual-v3.0": 1024,
    "embed-english-light-v3.0": 384,
    "embed-multilingual-light-v3.0": 384,
    "voyage-3-lite": 1536,
    "voyage-3": 1024,
    "voyage-code-3": 1536,
}
OTHER_DIMENSION = 1536


def dimension(model: str) -> int:
    return DIMENSIONS.get(model, OTHER_DIMENSION)


def embedded_query(text: str, provider) -> list[float]:
    """The vector of one query text, for vector_search over vectors of the same provider."""
    return [float(x) for x in provider.embed([text if text.strip() else "[empty]"])[0]]


def embedded(df: DataFrame, text: str, provider, out: str = "embedding", batch: int = EMBED_BATCH) -> DataFrame:
    """df with an embedding of each text, in batches; a failed batch fails the job."""

    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in provider.embed(texts[i : i + batch])])

    apply.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(apply, "array<double>")(F.col(text)))


def batch_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))
