"""Text, template and JSON expressions. All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def js_number(c: Column) -> Column:
    """A double as JavaScript writes it: 100, 0.00045, 1e+21."""
    x = c.cast("double")
    size = F.abs(x)
    plain = F.when(size < 1, x.try_cast(T.DecimalType(38, 24)).cast("string")).otherwise(x.try_cast(T.DecimalType(38, 17)).cast("string"))
    plain = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), "E-", "e-"), "E", "e+")
    return F.when(x == 0, "0").when((size >= 1e-6) & (size < 1e20), plain).otherwise(power)


def js_string(c: Column, kind: T.DataType) -> Column:
    """A column as JavaScript's String() writes it; null stays null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return js_number(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def interpolate(template: str, schema: T.StructType) -> Column:
    """{{column}} replaced by the row's value, in one pass; null and unknown columns become (empty)."""
    names = {f.name: f.dataType for f in schema}
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{([A-Za-z0-9_]+)\}\}", template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.coalesce(js_string(F.col(f"`{m[1]}`"), names[m[1]]), F.lit("(empty)")) if m[1] in names else F.lit("(empty)"))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def column_references(template: Column) -> Column:
    """Every {{reference}} of a template, trimmed, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(template, F.lit(r"\{\{([^}]+)\}\}"), F.lit(1)), lambda x: F.trim(x))


def display_template(template: str, names: Mapping[str, str]) -> str:
    """Column ids in a template replaced by display names."""
    return re.sub(r"\{\{([^}]+)\}\}", lambda m: "{{" + names.get(m[1].strip(), m[1].strip()) + "}}", template)


def sanitized(name: Column) -> Column:
    """A name with only ASCII word characters, dots and dashes, and no leading digit."""
    clean = F.regexp_replace(name, r"[^A-Za-z0-9_.-]", "_")
    return F.regexp_replace(clean, r"^([0-9])", "_$1")


def lenient_json(text: Column) -> Column:
    """VARIANT from a model's answer: the text itself, else its first fenced block, else from first to last brace."""
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
    braces = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braces, F.lit(""))))


def field(json: Column, name: str, kind: str = "string") -> Column:
    """A field of a JSON text, formatted for its kind: numbers parse or are 0, arrays and objects are JSON text.

    A missing or null field is null.
    """
    raw = F.get_json_object(json, f"$['{name}']")
    if kind == "number":
        return F.when(raw.isNotNull(), F.coalesce(raw.try_cast("double"), F.lit(0.0)))
    if kind == "boolean":
        return F.when(raw.isNotNull(), ~F.lower(raw).isin("false", "0", ""))
    return raw


def violations(json: Column, schema: Sequence[Mapping]) -> Column:
    """Messages on what a JSON text lacks by a schema of {name, type, required, enum, min_items, max_items}."""
    checks: list[Column] = []
    for f in schema:
        raw = F.get_json_object(json, f"$['{f['name']}']")
        if f.get("required", True):
            checks.append(F.when(raw.isNull(), F.lit(f"{f['name']}: required")))
        if f["type"] == "number":
            checks.append(F.when(raw.isNotNull() & raw.try_cast("double").isNull(), F.lit(f"{f['name']}: not a number")))
        if f["type"] == "boolean":
            checks.append(F.when(raw.isNotNull() & ~raw.isin("true", "false"), F.lit(f"{f['name']}: not a boolean")))
        if f.get("enum"):
            checks.append(F.when(raw.isNotNull() & ~raw.isin(*f["enum"]), F.lit(f"{f['name']}: not one of {', '.join(f['enum'])}")))
        if f["type"].startswith("array"):
            size = F.json_array_length(raw)
            checks.append(F.when(raw.isNotNull() & size.isNull(), F.lit(f"{f['name']}: not an array")))
            if (n := f.get("min_items")) is not None:
                checks.append(F.when(size < n, F.lit(f"{f['name']}: fewer than {n} items")))
            if (n := f.get("max_items")) is not None:
                checks.append(F.when(size > n, F.lit(f"{f['name']}: more than {n} items")))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def schema_prompt(schema: Sequence[Mapping]) -> str:
    """The lines that ask a model for JSON of a schema."""
    lines = [f'  "{f["name"]}": {"|".join(f["enum"]) if f.get("enum") else f["type"]}' + ("" if f.get("required", True) else " (optional)") for f in schema]
    return "\n\nAnswer with JSON only, of this shape:\n{\n" + ",\n".join(lines) + "\n}"


def contains_literally(columns: Sequence[Column], query: str) -> Column:
    """Whether any column has the query in it, whatever the case; nothing in the query is a wildcard."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c.cast("string")).contains(query.lower()), F.lit(False)) for c in columns], F.lit(False))


def compose_single(c: Column, kind: T.DataType = T.StringType()) -> Column:
    return F.coalesce(js_string(c, kind), F.lit(""))


def compose_multi(columns: Sequence[tuple[Column, T.DataType]], separator: str = "\n") -> Column:
    return F.concat_ws(separator, *[compose_single(c, k) for c, k in columns])


def embeddable(text: Column) -> Column:
    """Blank texts can't be embedded and are named so."""
    return F.when(F.trim(text) == "", F.lit("[empty]")).otherwise(text)


def parameter_count(model: Column) -> Column:
    """The last size in a model's name, as 7B or 350M."""
    return F.try_element_at(F.regexp_extract_all(F.upper(model), F.lit(r"([0-9]+[BMK])"), F.lit(1)), F.lit(-1))


def masked(key: str) -> str:
    return "" if not key else "*" * max(0, len(key) - 4) + key[-4:]
