"""Readers of JSON, JSONL and CSV logs: lines as VARIANT rows, format detection, flattening to a table."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import read_rows

FORMATS = ("message-centric", "langfuse", "langsmith", "arize", "turn-level")
#: Keys under which a document's rows are looked for, in this order.
ROW_KEYS = ("data", "items", "results", "records", "rows", "documents")
DEPTH = {"message-centric": 4, "langfuse": 5, "langsmith": 5, "arize": 5, "turn-level": 1}
MAX_ITEMS, MAX_CHARS = 1000, 10_000
LARGE = 64 << 20


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of each non-blank line."""
    return spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")


def sample(spark: SparkSession, path: str, most: int = 100, most_bytes: int = 1 << 20) -> DataFrame:
    """(n, line) of the first non-blank lines, as many as fit the bounds, the first in any case."""
    head = lines(spark, path).limit(most).withColumn("n", F.monotonically_increasing_id())
    before = F.coalesce(F.sum(F.octet_length("line") + 1).over(_in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return head.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.octet_length("line") <= most_bytes)).select("n", "line")


def read_jsonl(spark: SparkSession, path: str, some: bool = False) -> DataFrame:
    """(line, v) of each line that is JSON; others are left out. some: it is an error if there are lines and none is JSON."""
    # As a generator's output, v is parsed once; a filter on a column moves below it and parses again.
    rows = lines(spark, path).select("line", F.explode_outer(F.array(F.try_parse_json("line"))).alias("v"))
    good = rows.where("v is not null")
    if some and good.isEmpty() and not rows.isEmpty():
        raise ValueError(f"no line of {path} is JSON")
    return good


_SPACE = re.compile(r"[ \t\r\n]*")


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _members(text: str) -> list[tuple[int, int]]:
    """The places in text of the rows of its JSON document; ValueError if it isn't one document."""
    decode = json.JSONDecoder(parse_constant=_constant).raw_decode

    def skip(at: int) -> int:
        return _SPACE.match(text, at).end()

    def several(at: int, close: str, keyed: bool) -> tuple[list[tuple[str | None, int, int]], int]:
        """(key, start, end) of an array's items or an object's values, and the place after it; at is that of its bracket."""
        found, at = [], skip(at + 1)
        if text[at : at + 1] == close:
            return found, at + 1
        while True:
            key = None
            if keyed:
                key, at = decode(text, at)
                at = skip(at)
                if not isinstance(key, str) or text[at : at + 1] != ":":
                    raise ValueError(f"no key and colon before place {at}")
                at = skip(at + 1)
            start, at = at, decode(text, at)[1]
            found.append((key, start, at))
            at = skip(at)
            if text[at : at + 1] == close:
                return found, at + 1
            if text[at : at + 1] != ",":
                raise ValueError(f"no comma at place {at}")
            at = skip(at + 1)

    start = skip(0)
    if text[start : start + 1] == "[":
        found, end = several(start, "]", False)
        rows = [x[1:] for x in found]
    elif text[start : start + 1] == "{":
        found, end = several(start, "}", True)
        arrays = {k: at for k, at, _ in reversed(found) if text[at] == "["}
        first = next((k for k in ROW_KEYS if k in arrays), None)
        rows = [(start, end)] if first is None else [x[1:] for x in several(arrays[first], "]", False)[0]]
    else:
        end = decode(text, start)[1]
        rows = [(start, end)]
    if skip(end) != len(text):
        raise ValueError(f"more than one value, at place {skip(end)}")
    return rows


def _rows_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("value"):
            text = (text.as_py() or "").removeprefix("\ufeff")
            rows, error = [], None
            try:
                rows = _members(text) if text.strip() else []
            except (ValueError, RecursionError) as e:
                error = str(e) or "nested too deep"
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([error])], ["item", "error"])
            for i in range(0, len(rows), 1000):
                items = [text[a:b] for a, b in rows[i : i + 1000]]
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.nulls(len(items), pa.string())], ["item", "error"])


def _items(spark: SparkSession, path: str) -> DataFrame:
    """(item, error) of the JSON texts of each file's rows, or why the file is no JSON document.

    Items are cut from the text, so that only each of them, not the file, has to fit a VARIANT.
    """
    return spark.read.text(path, wholetext=True).mapInArrow(_rows_of_texts, "item string, error string")


def read_json(spark: SparkSession, path: str | list[str], large: int = LARGE) -> DataFrame:
    """(v) of each row of a JSON document: an array's items, the items of its first array of rows, else itself.

    A file that isn't one JSON document, and a row beyond the size of a VARIANT, are errors. Files of more than LARGE bytes
    in all are read by ranges of bytes (ranges.read_rows), smaller ones each by one task.
    """
    if stored_bytes(spark, path).first()["bytes"] > large:
        items, whole = read_rows(spark, path, ROW_KEYS)
        rows = items.select(F.parse_json("item").alias("v"))
        return rows.unionByName(read_json(spark, whole, 2**63 - 1)) if whole else rows
    bad = F.raise_error(F.concat(F.lit(f"not a JSON document in {path}: "), F.col("error"))).cast("string")
    return _items(spark, path).select(F.parse_json(F.when(F.col("error").isNull(), F.col("item")).otherwise(bad)).alias("v"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; all columns are strings, blank lines are left out, quoted line ends are kept."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')


def _truthy(path: str) -> Column:
    """Whether a value is there and isn't null, false, 0 or the empty string."""
    x = F.try_variant_get("v", path, "variant")
    kind, text = F.schema_of_variant(x), F.try_variant_get("v", path, "string")
    return F.coalesce(F.when(kind == "VOID", False).when(kind == "STRING", text != "").otherwise(F.coalesce(~text.isin("0", "false"), x.isNotNull())), F.lit(False))


def _has(path: str) -> Column:
    return F.coalesce(F.variant_get("v", path, "variant").isNotNull(), F.lit(False))


def _is_array(path: str) -> Column:
    return F.try_variant_get("v", path, "array<variant>").isNotNull()


def _shape(name: str) -> Column:
    """Whether VARIANT column v is a record of the format."""
    if name == "langfuse":
        first = _truthy("$.observations[0].trace_id") & F.coalesce(F.try_variant_get("v", "$.observations[0].type", "string").isin("SPAN", "GENERATION", "EVENT"), F.lit(False))
        return _truthy("$.id") & _is_array("$.observations") & (first | (_truthy("$.timestamp") & (_has("$.public") | _has("$.bookmarked"))))
    if name == "langsmith":
        return _truthy("$.run_type") & F.coalesce(F.try_variant_get("v", "$.run_type", "string").isin("llm", "chain", "tool"), F.lit(False)) & _has("$.inputs") & _has("$.outputs")
    return (_truthy("$['context.trace_id']") | _truthy("$['context.span_id']")) & _has("$.attributes")


def detect(spark: SparkSession, path: str) -> DataFrame:
    """(format, confidence), best first: the share of the first lines that look like each format.

    Reads the first 100 lines, and the document as a whole where its first line is the start of one.
    """
    head = sample(spark, path).withColumn("v", F.try_parse_json("line"))
    head = head.orderBy("n").limit(10).withColumn("at", F.row_number().over(_in_order()))
    good = F.col("v").isNotNull()
    message = good & _truthy("$.role") & _truthy("$.content") & _truthy("$.timestamp") & F.coalesce(F.try_variant_get("v", "$.role", "string").isin("user", "assistant"), F.lit(False))
    first, five = F.lower(F.min(F.when(F.col("at") == 1, F.col("line")))), F.col("at") <= 5
    chain = F.lit(0.3) * F.count_if(five & _truthy("$.trace_id") & _truthy("$.dotted_order")) + F.lit(0.3) * F.count_if(five & _has("$.execution_order") & _truthy("$.status"))
    needed = first.contains("user_message") & first.contains("assistant_message")
    extra = reduce(lambda a, b: a + b, [first.contains(c).cast("int") for c in ("turn_id", "session_id", "timestamp", "user_id")])
    scores = head.agg(
        F.coalesce(F.lit(0.5) * F.try_divide(F.count_if(good), F.count("*")) + F.lit(0.5) * F.try_divide(F.count_if(message), F.count_if(good)), F.lit(0.0)).alias("message-centric"),
        F.least(F.lit(1.0), F.lit(0.4) * F.count_if(five & good & _shape("langfuse"))).alias("langfuse"),
        F.least(F.lit(1.0), F.lit(0.4) * F.count_if(five & good & _shape("langsmith")) + chain).alias("langsmith"),
        F.least(F.lit(1.0), F.lit(0.5) * F.count_if(five & good & _shape("arize"))).alias("arize"),
        F.when(needed, F.lit(0.6) + F.lit(0.1) * extra).otherwise(F.lit(0.0)).alias("turn-level"),
    )
    top = lines(spark, path).limit(1).select("line", F.try_parse_json("line").isNotNull().alias("whole")).first()
    if top and not top["whole"] and top["line"].lstrip("\ufeff \t")[:1] in ("{", "["):
        document = _items(spark, path).where("error is null").select(F.parse_json("item").alias("v"))
    else:
        # A line that is a document: of JSONL the first one, as a parser of the whole file stops after it.
        v = F.try_parse_json(F.lit(top["line"] if top else None).cast("string"))
        one = spark.range(1).select(v.alias("v")).where("v is not null")
        inner = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ROW_KEYS])
        document = one.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), inner, F.array("v"))).alias("v"))
    whole = document.agg(*[F.max(F.when(_shape(n), 1.0).otherwise(0.0)).alias(n) for n in ("langfuse", "arize")])
    wide = scores.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("format"), F.col(f"`{n}`").alias("confidence")) for n in FORMATS])).alias("place", "x"))
    single = whole.select(F.explode(F.array(*[F.struct(F.lit(n).alias("format"), F.coalesce(F.col(n), F.lit(0.0)).alias("whole")) for n in ("langfuse", "arize")])).alias("y")).select("y.*")
    joined = wide.select("place", "x.*").join(single, "format", "left").withColumn("confidence", F.greatest("confidence", F.coalesce("whole", F.lit(0.0))))
    return joined.orderBy(F.col("confidence").desc(), "place").select("format", "confidence")


def _in_order() -> WindowSpec:
    """The order of a bounded number of first lines."""
    return Window.orderBy("n")


# What users read when no format is sure.
UNCLEAR = "File format not clearly detected. Please verify your data format."
LOW_CONFIDENCE = "Format appears to be {} but with low confidence. Please review field mappings."
NOTHING_FOUND = "Consider checking if your file contains the expected headers or JSON structure."


def suggestions(detected: DataFrame) -> DataFrame:
    """(suggestion) on what to check, from detect()'s five rows."""
    best = detected.agg(F.max("confidence").alias("c"), F.max_by("format", "confidence").alias("f"))
    unsure = F.concat(*[F.lit(LOW_CONFIDENCE.split("{}")[0]), F.col("f"), F.lit(LOW_CONFIDENCE.split("{}")[1])])
    cases = [F.when(F.col("c") < 0.3, UNCLEAR), F.when((F.col("c") > 0.3) & (F.col("c") < 0.7), unsure), F.when(F.col("c") < 0.2, NOTHING_FOUND)]
    return best.select(F.explode(F.array_compact(F.array(*cases))).alias("suggestion"))


def is_jsonl(spark: SparkSession, path: str) -> bool:
    """Whether the file has several lines of which the first is a whole JSON object or array; a parser of the whole file
    would stop after it."""
    head = lines(spark, path).limit(2).collect()
    first = spark.createDataFrame([(head[0]["line"],)], "line string").where("line rlike '^\\\\s*[{\\\\[]' and try_parse_json(line) is not null") if len(head) > 1 else None
    return first is not None and not first.isEmpty()


def load(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A flat table of the file: by its format, or by what it parses as: JSON, JSONL, else CSV.

    Without a format, a file is CSV if it has no row of JSON; one of several files that alone isn't JSON is an error.
    """
    if fmt == "turn-level" or fmt == "csv":
        return read_csv(spark, path)
    by_line = fmt in ("message-centric", "langsmith", "jsonl") or fmt != "json" and is_jsonl(spark, path)
    rows = read_jsonl(spark, path, some=fmt is not None).select("v") if by_line else read_json(spark, path)
    if fmt is None and (rows.isEmpty() if by_line else _items(spark, path).where("error is null").isEmpty()):
        return read_csv(spark, path)
    return flatten(observations(rows) if fmt == "langfuse" else rows, DEPTH.get(fmt or "", 5))


def observations(rows: DataFrame) -> DataFrame:
    """Langfuse traces as one row an observation, under the trace's id, name, timestamp, user and session."""
    fields = {"trace_id": "id", "trace_name": "name", "trace_timestamp": "timestamp", "user_id": "user_id", "session_id": "session_id"}
    head = [F.try_variant_get("v", f"$.{k}", "string").alias(n) for n, k in fields.items()]
    flat = rows.select(*head, F.explode_outer(F.try_variant_get("v", "$.observations", "array<variant>")).alias("observation"))
    return flat.select(F.parse_json(F.to_json(F.struct(*fields, "observation"))).alias("v"))


def _cut(c: Column) -> Column:
    return F.when(F.length(c) > MAX_CHARS, F.concat(F.substring(c, 1, MAX_CHARS), F.lit("..."))).otherwise(c)


def _columns(c: Column, kind: T.DataType, name: str, depth: int) -> list[Column]:
    """Dotted columns of a value: structs by field down to depth, then JSON; arrays of values joined, others as JSON."""
    if isinstance(kind, T.StructType) and kind.fields and depth > 0:
        return [x for f in kind for x in _columns(c.getField(f.name), f.dataType, f"{name}.{f.name}" if name else f.name, depth - 1)]
    if isinstance(kind, T.ArrayType):
        items = F.slice(c, 1, MAX_ITEMS)
        text = F.to_json(items) if isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else F.array_join(F.filter(items, lambda x: x.isNotNull()).cast("array<string>"), ", ")
        return [_cut(F.when(F.size(c) == 0, F.lit("[]")).otherwise(text)).alias(name)]
    if isinstance(kind, (T.StructType, T.MapType)):
        return [F.to_json(c).alias(name)]
    if isinstance(kind, T.VariantType):
        return [F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c)).alias(name)]
    if isinstance(kind, T.DecimalType):
        return [c.cast("double" if kind.scale else "long").alias(name)]
    return [c.alias(name)]


def flatten(rows: DataFrame, depth: int = 5, column: str = "v") -> DataFrame:
    """A VARIANT column's objects as a table; one pass finds the schema of all rows, the other selects its fields.

    Types are the widest of all rows. Missing and null values are null.
    """
    found = rows.agg(F.schema_of_variant_agg(column)).first()[0] or "VOID"
    ddl = found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    if not ddl.startswith("STRUCT<"):
        return rows.select(F.to_json(column).alias("value"))
    schema = rows.sparkSession.createDataFrame([], f"x {ddl}").schema["x"].dataType
    typed = rows.select(F.try_variant_get(column, "$", ddl).alias("x"))
    return typed.select(*_columns(F.col("x"), schema, "", depth))


def preview(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """(n, v, error) of the first lines; a line that is no JSON is an error record."""
    v = F.try_parse_json("line")
    return sample(spark, path, n).select("n", v.alias("v"), F.when(v.isNull(), F.lit("not JSON")).alias("error"))


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) under a path; file contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def validate_lines(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(error) of what is wrong with the first lines for a format."""
    head = lines(spark, path).limit(10)
    bad, n = F.count_if(F.try_parse_json("line").isNull()), F.count("*")
    checks = [F.when(n == 0, F.lit("the file is empty"))]
    checks.append(F.when(F.sum(F.col("line").contains(",").cast("int")) == 0, F.lit("no comma in the first lines")) if fmt == "turn-level" else F.when(bad * 2 > n, F.lit("more than half of the first lines are no JSON")))
    return head.agg(F.array_compact(F.array(*checks)).alias("e")).select(F.explode("e").alias("error"))
