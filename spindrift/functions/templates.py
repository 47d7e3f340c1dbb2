"""Prompt templates as documents of text and variables, and the prompts that they become.

A document is {"lines": [[part, ...], ...]}; a part is a string or a variable {"id", "name", "required", "default"}. Such
documents are a template's configuration: small, made and read on the driver. What they become is a `{{column}}` prompt,
which `text.interpolate` fills row by row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

_VARIABLE = re.compile(r"\{\{([A-Za-z0-9_]+)\}\}")
HISTORY_KEYS = ("conversationIdColumn", "sequenceIdColumn", "aggregationStrategy")


@dataclass(frozen=True)
class Prompt:
    """A prompt with column ids, the same with display names, and which variables still lack a column."""

    text: str
    shown: str
    unmapped: list[dict] = field(default_factory=list)
    mapped_count: int = 0
    total_count: int = 0

    @property
    def valid(self) -> bool:
        return not self.unmapped


def document(template: str, variables: Sequence[Mapping]) -> dict:
    """The document of a template text; `{{x}}` is a variable where one has x as its slug or id, and text where none has."""
    known = {v[k]: v for k in ("id", "slug") for v in reversed(variables) if v.get(k)}

    def part(piece: str, is_name: bool) -> str | dict:
        if not is_name:
            return piece
        v = known.get(piece)
        if v is None:
            return "{{" + piece + "}}"
        return {"id": v["id"], "name": v["display_name"], "required": v.get("required", True), "default": v.get("default")}

    lines = [[part(p, i % 2 == 1) for i, p in enumerate(_VARIABLE.split(line)) if p] for line in template.split("\n")]
    return {"lines": lines}


def variables(doc: Mapping) -> list[dict]:
    """All variables of a document, in order, repeats kept."""
    return [p for line in doc.get("lines", ()) for p in line if not isinstance(p, str)]


def prompt(doc: Mapping, columns: Mapping[str, Mapping]) -> Prompt:
    """The prompt of a document; columns gives {"slug", "name"} of the column that a variable id is mapped to.

    A variable without a column is its default text if it has one, else its name in braces; if it is required, the prompt
    isn't valid.
    """

    def written(p: str | Mapping, key: str) -> str:
        if isinstance(p, str):
            return p
        if p["id"] in columns:
            return "{{" + columns[p["id"]][key] + "}}"
        return p["default"] if p.get("default") is not None else "{{" + p["name"] + "}}"

    text, shown = ("\n".join("".join(written(p, key) for p in line) for line in doc.get("lines", ())).strip() for key in ("slug", "name"))
    found = variables(doc)
    open_ = [{"id": v["id"], "name": v["name"]} for v in found if v["id"] not in columns and v.get("default") is None and v.get("required", True)]
    return Prompt(text, shown, open_, sum(v["id"] in columns for v in found), len(found))


def filled(template: str, values: Mapping[str, str]) -> str:
    """Every {key} of a template replaced by its value, key after key; unknown keys stay."""
    for key, value in values.items():
        template = template.replace("{" + key + "}", value)
    return template


def history_config(text: str) -> dict | None:
    """The conversation history that a column's prompt configures as JSON; None if it is a plain prompt."""
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and all(k in found for k in HISTORY_KEYS) else None


def few_shot_preview(prompt: str, examples: Sequence[Mapping], names: Mapping[str, str], most: int = 3) -> str:
    """A prompt as it will be sent with corrected examples: of each its referenced columns, the wrong and the right output.

    An example is {"input": {column: value}, "wrong", "right"}; names gives the columns' display names.
    """
    references = list(dict.fromkeys(x.strip() for x in re.findall(r"\{\{([^}]+)\}\}", prompt)))
    shown = re.sub(r"\{\{([^}]+)\}\}", lambda m: "{{" + names.get(m[1].strip(), m[1].strip()) + "}}", prompt)
    blocks = []
    for i, e in enumerate(examples[:most], 1):
        rows = [f"{names.get(c, c)}: " + str(e["input"][c]).replace("\n", "\n  ") for c in references if c in e["input"]]
        blocks.append("\n".join([f"Example {i}:", *rows, f"Wrong output: {e['wrong']}", f"Right output: {e['right']}"]))
    return "\n\n".join([shown, *blocks])
