"""Rows of JSON documents of any size, read by byte ranges.

Spark's text source cuts files at closing braces, in ranges of bytes, so the tasks of one file read it together. What a brace
or comma means depends on all that comes before it; therefore each range first tells, for either case of beginning within
a string or not, how many quotes and open brackets it adds. From these numbers follows how each range begins. Then the
ranges find the array of rows and its end, and at last cut their text at the commas between rows; a row that goes over the end
of a range is put together from its pieces.

An array of rows is the document itself or the first of an object's members that is named in ROW_KEYS (written without
escapes). Whatever isn't one JSON document is an error: brackets or strings without end, text after the end, and rows or
other members that don't parse.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import stored

CHUNK = 4 << 20
"""Bytes that are scanned at once."""
_SPACE = b" \t\r\n"
_ESCAPE = re.compile(rb"\\.", re.S)


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, size, value) of the text between closing braces; start is that of the range that reads it."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, start, size, text) in order; each closing brace is put back, one more than there is if a file ends without."""
    held: list[bytes] = []
    last, room = None, CHUNK
    for batch in batches:
        for *key, value in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "size", "value")), strict=True):
            if held and (key != last or room < 0):
                yield (*last, b"}".join([*held, b""]))
                held, room = [], CHUNK
            last = key
            held.append(value)
            room -= len(value) + 1
    if held:
        yield (*last, b"}".join([*held, b""]))


def _bare(text: bytes) -> bytes:
    """The text with all escapes blanked, of the same length."""
    return _ESCAPE.sub(b"  ", text) if b"\\" in text else text


_NUMBERS = ("size", "quotes", "outside", "inside", "bytes", "last", "first")


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: its quotes, the brackets that it opens if it begins outside of a string or inside, its bytes, where
    its last visible byte is, the final brace aside, and its first one with that byte."""
    found: dict[tuple[str, int], dict] = {}
    for file, start, size, text in _chunks(batches):
        s = found.setdefault((file, start), dict.fromkeys(_NUMBERS, 0) | {"size": size, "last": -1, "first": -1, "head": None})
        parts = _bare(text).split(b'"')
        sides = [sum(p.count(b"[") + p.count(b"{") - p.count(b"]") - p.count(b"}") for p in parts[k::2]) for k in (0, 1)]
        s["outside"] += sides[s["quotes"] % 2]
        s["inside"] += sides[1 - s["quotes"] % 2]
        s["quotes"] += len(parts) - 1
        bom = 3 if start == 0 and not s["bytes"] and text.startswith(b"\xef\xbb\xbf") else 0
        if s["head"] is None and (solid := text[bom:].lstrip(_SPACE)):
            s["first"], s["head"] = s["bytes"] + len(text) - len(solid), solid[:1].decode("latin-1")
        before = len(text[:-1].rstrip(_SPACE))
        s["last"] = s["bytes"] + before - 1 if before else s["bytes"] - 1  # a chunk ends with a brace
        s["bytes"] += len(text)
    for (file, start), s in found.items():
        cells = [pa.array([file]), *(pa.array([x], pa.int64()) for x in (start, *(s[n] for n in _NUMBERS))), pa.array([s["head"]], pa.string())]
        yield pa.RecordBatch.from_arrays(cells, ["file", "start", *_NUMBERS, "head"])


class _Begin:
    """How a range begins: its first byte's offset, whether within a string, and how deep."""

    def __init__(self, offset: int, inside: bool, depth: int) -> None:
        self.offset, self.inside, self.depth = offset, inside, depth


def _scan(batches: Iterator[pa.RecordBatch], begins: dict, ends: dict) -> Iterator[tuple[str, int, int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(file, start, offset, text, bytes, whether outside of strings, depth after each byte) of all chunks."""
    state: dict[tuple[str, int], _Begin] = {}
    for file, start, _, text in _chunks(batches):
        b = begins.get((file, start))
        if b is None:
            continue
        s = state.setdefault((file, start), _Begin(*b))
        text = text[: max(0, ends[file] - s.offset)]  # without the brace that the file doesn't end with
        x = np.frombuffer(_bare(text), np.uint8)
        quote = x == 34
        inside = (np.cumsum(quote) + s.inside) % 2 == 1
        outside = ~inside & ~quote
        step = np.where(outside & ((x == 91) | (x == 123)), 1, 0) - np.where(outside & ((x == 93) | (x == 125)), 1, 0)
        depth = s.depth + np.cumsum(step)
        yield file, start, s.offset, text, x, outside, depth
        if len(x):
            s.offset, s.inside, s.depth = s.offset + len(x), bool(inside[-1]), int(depth[-1])


def _collected(rows: DataFrame, make: Callable, schema: str) -> list:
    return rows.mapInArrow(make, schema).collect()


def read_rows(spark: SparkSession, path: str, keys: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(item) of the JSON texts of all rows of the files under a path, and the files that are one row as a whole.

    The driver holds a few numbers for each range of bytes.
    """
    rows = _ranges(spark, path)
    kinds = "file string, start long, " + ", ".join(f"{n} long" for n in _NUMBERS) + ", head string"
    about = sorted(_collected(rows, _summary, kinds), key=lambda r: (r["file"], r["start"]))
    files: dict[str, list] = {}
    for r in about:
        files.setdefault(r["file"], []).append(r)
    begins, ends, level, starts, solid, whole = {}, {}, {}, {}, {}, []
    for file, parts in files.items():
        offset, inside, depth, head = 0, False, 0, (None, -1)
        # 1 if the file doesn't end with the brace that was put back; Spark leaves out a byte order mark of three bytes.
        missing = sum(p["bytes"] for p in parts) - parts[0]["size"]
        missing += 3 if missing < 0 else 0
        if missing not in (0, 1):
            raise ValueError(f"{file} has changed while it was read")
        for p in parts:
            begins[file, p["start"]] = (offset, inside, depth)
            if head[0] is None and p["head"] is not None:
                head = p["head"], offset + p["first"]
            solid[file] = offset + p["last"]
            depth += p["inside"] if inside else p["outside"]
            inside ^= bool(p["quotes"] % 2)
            offset += p["bytes"]
        ends[file] = offset - missing
        if head[1] >= ends[file]:
            continue  # nothing but space
        if not missing:
            solid[file] = offset - 1
        elif not inside:
            depth += 1
        if inside or depth:
            raise ValueError(f"not a JSON document in {file}: {'a string' if inside else 'a bracket'} has no end")
        if head[0] == "[":
            level[file], starts[file] = 1, head[1]
        elif head[0] == "{":
            level[file] = 2
        else:
            whole.append(file)
    # The first array among the keys of each object.
    named = re.compile(rb'"(' + "|".join(keys).encode() + rb')"[ \t\r\n]*:[ \t\r\n]*\[')
    objects = {f for f, n in level.items() if n == 2}

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = {k: v for k, v in begins.items() if k[0] in objects}
        for file, _, offset, text, _, outside, depth in _scan(batches, mine, ends):
            at = [(m[1].decode(), m.end() - 1) for m in named.finditer(text)]
            at = [(k, p) for k, p in at if outside[p] and depth[p] == 2]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.string()), pa.array([k for k, _ in at], pa.string()), pa.array([offset + p for _, p in at], pa.int64())], ["file", "key", "at"])

    if objects:
        found = rows.mapInArrow(members, "file string, key string, at long").groupBy("file", "key").agg(F.min("at").alias("at")).collect()  # a few keys a file
        places = {(r["file"], r["key"]): r["at"] for r in found}
        for file in objects:
            key = next((k for k in keys if (file, k) in places), None)
            if key is None:
                whole.append(file)
                del level[file]
            else:
                starts[file] = places[file, key]

    # Where each array of rows begins and ends.
    def closings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, seen = {k: v for k, v in begins.items() if k[0] in level}, set()
        for file, start, offset, _, x, outside, depth in _scan(batches, mine, ends):
            if (file, start) in seen:
                continue
            later = np.arange(offset, offset + len(x)) > starts[file]
            close = np.flatnonzero(later & outside & ((x == 93) | (x == 125)) & (depth == level[file] - 1))
            if len(close):
                seen.add((file, start))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([offset + int(close[0])]), pa.array([chr(x[close[0]])])], ["file", "at", "bracket"])

    stops: dict[str, tuple[int, str]] = {}
    for r in _collected(rows, closings, "file string, at long, bracket string"):
        stops[r["file"]] = min(stops.get(r["file"], (r["at"], r["bracket"])), (r["at"], r["bracket"]))
    for file in level:
        at, bracket = stops.get(file, (-1, ""))
        if bracket != "]":
            raise ValueError(f"not a JSON document in {file}: the array of rows has no end")
        if level[file] == 1 and solid[file] != at:
            raise ValueError(f"not a JSON document in {file}: text after its end")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(file, start, at, ended, piece) of rows and of what is around them (at: -1)."""
        mine = {k: v for k, v in begins.items() if k[0] in level}
        open_: dict[tuple[str, int], tuple[int | None, list[bytes]]] = {}
        for file, start, offset, text, x, outside, depth in _scan(batches, mine, ends):
            out: list[tuple] = []
            own, begin, stop = level[file], starts[file] + 1, stops[file][0]
            low, high, stop_at = min(max(0, begin - offset), len(x)), min(max(0, stop - offset), len(x)), stop - offset
            if own == 2:
                out += [(file, offset + a, -1, True, text[a:b]) for a, b in ((0, low), (high, len(x))) if a < b]
            if 0 < begin - offset <= len(x):
                open_[file, start] = (begin, [])
            if low < high or 0 <= stop_at < len(x):
                cuts = low + np.flatnonzero((outside & (depth == own) & (x == 44))[low:high])
                place, held = open_.pop((file, start), (None, []))
                edge = low
                for c in cuts.tolist():
                    out.append((file, start, place, True, b"".join([*held, text[edge:c]])))
                    place, held, edge = offset + c + 1, [], c + 1
                held.append(text[edge:high])
                if 0 <= stop_at < len(x):
                    text_left = b"".join(held)
                    if place != begin or text_left.strip(_SPACE):  # an empty array has no row
                        out.append((file, start, place, True, text_left))
                else:
                    open_[file, start] = (place, held)
            yield _pieces(out)
        yield _pieces([(f, s, place, False, b"".join(held)) for (f, s), (place, held) in open_.items() if place is not None or held])

    if not level:
        return spark.createDataFrame([], "item string"), whole
    found = stored(rows.mapInArrow(pieces, "file string, start long, at long, ended boolean, piece binary"), "pieces")
    items, rest = _joined(found)
    rest.select(F.col("rest").alias("item")).mapInArrow(_one_value, "item string").agg(F.count("item")).collect()  # it has to be JSON too
    return items.mapInArrow(_one_value, "item string"), whole


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _one_value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts; an error if one isn't just one JSON value."""
    decode = json.JSONDecoder(parse_constant=_constant).raw_decode
    for batch in batches:
        for text in batch.column("item"):
            text = text.as_py().strip(" \t\r\n")
            if decode(text)[1] != len(text):
                raise ValueError(f"not a JSON document: more than one value in {text[:80]}")
        yield batch


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["file", "start", "at", "ended", "piece"])


def _joined(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item) of all rows, and (file, rest) of what is around them; pieces that are whole rows stay as they are."""
    row = found.where("at is null or at >= 0")
    whole = row.where("at is not null and ended").select("file", F.col("at"), F.col("piece").cast("string").alias("item"))
    # At most two pieces a range: the row that it ends, and the one that it leaves open.
    part = row.where("at is null or not ended").withColumn("of", F.last("at", True).over(W.partitionBy("file").orderBy("start", F.col("at").isNotNull())))
    text = F.transform(F.array_sort(F.collect_list(F.struct("start", F.col("at").isNotNull().alias("open"), "piece"))), lambda x: x["piece"])
    mended = part.groupBy("file", "of").agg(F.aggregate(text, F.lit(b""), lambda a, x: F.concat(a, x)).cast("string").alias("item"))
    rest = found.where("at = -1").groupBy("file").agg(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), F.lit(b""), lambda a, x: F.concat(a, x)).cast("string").alias("rest"))
    return whole.select("item").unionByName(mended.select("item")), rest
